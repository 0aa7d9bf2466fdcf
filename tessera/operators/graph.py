"""Graph steps over a neighbour table knn(src, dst, rank from 1, score)."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import components
from tessera.operators.profile import numbered, running_sums
from tessera.operators.quantiles import quantiles
from tessera.operators.skew import with_count
from tessera.sources.lineage import cut


def mutual(knn: DataFrame, edge_top: int, reciprocal_top: int) -> DataFrame:
    """Edges src -> dst among the first edge_top whose dst has src among its first reciprocal_top."""
    back = knn.where(F.col("rank") <= reciprocal_top).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return knn.where(F.col("rank") <= edge_top).join(back, ["src", "dst"], "left_semi")


def shared_counts(edges: DataFrame, knn: DataFrame, shared_top: int) -> DataFrame:
    """edges with `shared`: how many of the first shared_top neighbours the two ends have in common."""
    near = knn.where(F.col("rank") <= shared_top)
    a = edges.select("src", "dst").join(near.select("src", F.col("dst").alias("x")), "src")
    n = a.join(near.select(F.col("src").alias("dst"), F.col("dst").alias("x")), ["dst", "x"]).groupBy("src", "dst").agg(F.count("*").alias("shared"))
    return edges.join(n, ["src", "dst"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)).cast("long"))


def density_z(knn: DataFrame, top: int = 20) -> DataFrame:
    """(id, z): z score, over all rows, of the mean of a row's first scores; population deviation, at least 1e-6."""
    d = knn.where(F.col("rank") <= top).groupBy(F.col("src").alias("id")).agg(F.avg("score").alias("d"))
    stats = d.agg(F.avg("d").alias("m"), F.greatest(F.stddev_pop("d"), F.lit(1e-6)).alias("s"))
    return d.join(F.broadcast(stats)).select("id", ((F.col("d") - F.col("m")) / F.col("s")).alias("z"))


def cluster_edges(knn: DataFrame, edge_top: int = 50, reciprocal_top: int = 100, shared_top: int = 50, shared_min: int = 2, rank_weight: float = 0.02, shared_weight: float = 0.04, density_penalty: float = 0.02, min_score: float | None = None, score_quantile: float | None = None) -> DataFrame:
    """(src, dst, rank, score, shared, weight): mutual edges weighted by score, rank, shared neighbours and the target's density."""
    if score_quantile is not None:
        found = quantiles(knn.where(F.col("rank") <= edge_top), "score", [score_quantile]).first()
        min_score = found["value"] if found else None
    edges = mutual(knn, edge_top, reciprocal_top)
    if min_score is not None:
        edges = edges.where(F.col("score") >= min_score)
    edges = shared_counts(edges, knn, shared_top)
    if shared_min > 0:
        edges = edges.where(F.col("shared") >= shared_min)
    z = density_z(knn).select(F.col("id").alias("dst"), "z")
    weight = F.col("score") + rank_weight / F.col("rank") + shared_weight * F.col("shared") / max(shared_top, 1) - density_penalty * F.col("z")
    return edges.join(z, "dst").select("src", "dst", "rank", "score", "shared", weight.alias("weight"))


def labelled_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over edges(src, dst), taken both ways; a node without edges is its own."""
    parts = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return nodes.select("id").join(parts, "id", "left").select("id", F.coalesce("component_id", "id").alias("component"))


def variant_components(nodes: DataFrame, ranking: DataFrame, variants: int, top: int) -> DataFrame:
    """(id, labels): for each variant (from 0) of ranking(variant, src, dst, rank, ...) the component of the rows that name each other among
    their first `top`, as one array. All variants are found together, as one graph of (variant, id)."""
    near = ranking.where(F.col("rank") <= top).select("variant", "src", "dst")
    both = near.join(near.select("variant", F.col("dst").alias("src"), F.col("src").alias("dst")), ["variant", "src", "dst"], "left_semi")
    node = lambda n: F.struct("variant", F.col(n).alias("id"))
    found = components(both.select(node("src").alias("a"), node("dst").alias("b")))
    own = found.select("id.variant", F.col("id.id").alias("id"), F.col("component_id.id").alias("label"))
    at = lambda v: F.max(F.when(F.col("variant") == v, F.col("label")))
    packed = own.groupBy("id").agg(*[at(v).alias(f"_{v}") for v in range(variants)])
    return nodes.select("id").join(packed, "id", "left").select("id", F.array(*[F.coalesce(f"_{v}", "id") for v in range(variants)]).alias("labels"))


def dense(labels: DataFrame, label: str = "label") -> DataFrame:
    """labels(id, label) with the labels numbered from 0 in their order, by ranges of the distinct labels."""
    names = numbered(labels.select(label).distinct(), [F.asc(label)], "_n")
    return labels.join(names, label).select("id", (F.col("_n") - 1).cast("long").alias(label))


def label_propagation(nodes: DataFrame, edges: DataFrame, iterations: int = 5, self_weight: float = 0.0, size_penalty: float = 0.0, most_edges: int = 100_000) -> DataFrame:
    """(id, label) after passes that visit rows in ascending order, each seeing the labels already changed in its pass.

    edges(src, dst, rank, weight). A row takes the label of greatest total weight, the smallest of equal ones; rows without edges keep
    their own id. Rows are run in blocks of consecutive ids with about most_edges edges, all passes at once (`block_passes`). Labels are
    numbered densely.

    With a size penalty a pass needs the sizes of all labels before it. Labels never leave a connected component and a component that
    does not change stays so: components of at most most_edges edges are then run by themselves, each in one group; larger ones
    together, each pass relaxed over the whole table (`relaxed_pass`), with the same result.
    """
    if size_penalty <= 0:
        passed = block_passes(blocks_of(edges, most_edges), iterations, self_weight)
        return dense(nodes.select("id").join(passed, "id", "left").select("id", F.coalesce("label", "id").alias("label")))
    parts = labelled_nodes(nodes, edges).where("component is not null")
    dealt = cut(edges.join(parts.select(F.col("id").alias("src"), "component"), "src").select("component", "src", "dst", "weight", "rank"))
    sizes = cut(dealt.groupBy("component").agg(F.count("*").alias("_edges")))
    small = dealt.join(sizes.where(F.col("_edges") <= most_edges), "component", "left_semi")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["src", "rank"])
        label = {int(i): int(i) for i in pd.concat([group["src"], group["dst"]]).unique()}
        rows = [(int(i), list(zip(g["dst"], g["weight"], strict=True))) for i, g in group.groupby("src", sort=True)]
        for _ in range(iterations):
            changed, count = 0, pd.Series(label).value_counts().to_dict()
            for i, near in rows:
                total: dict[int, float] = {label[i]: self_weight} if self_weight > 0 else {}
                for j, w in near:
                    total[label[int(j)]] = total.get(label[int(j)], 0.0) + float(w)
                best = max(total, key=lambda x: (total[x] / count.get(x, 1) ** size_penalty if size_penalty > 0 else total[x], -x))
                changed += best != label[i]
                label[i] = best
            if not changed:
                break
        return pd.DataFrame({"id": list(label), "label": list(label.values())})

    moved = small.groupBy("component").applyInPandas(run, "id long, label long")
    large = sizes.where(F.col("_edges") > most_edges)
    if large.limit(1).count():
        own = cut(dealt.join(F.broadcast(large), "component", "left_semi").select("src", "dst", "weight", "rank"))
        ids = own.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        moved = moved.unionByName(relaxed_propagation(ids, own, iterations, self_weight, size_penalty))
    return dense(nodes.select("id").join(moved, "id", "left").select("id", F.coalesce("label", "id").alias("label")))


def blocks_of(edges: DataFrame, most_edges: int) -> DataFrame:
    """edges(src, dst, rank, weight) with `block`: runs of consecutive src with about most_edges edges; a row's edges stay together."""
    edges = cut(edges.select("src", "dst", "rank", F.col("weight").cast("double").alias("weight")))
    own = edges.groupBy("src").agg(F.count("*").alias("_own"))
    placed = running_sums(own, [F.asc("src")], {"_before": "_own"}, earlier=True)
    return cut(edges.join(placed.select("src", F.floor(F.col("_before") / max(1, most_edges)).cast("long").alias("block")), "src"))


def packed_blocks(edges: DataFrame) -> DataFrame:
    """(block, held) of the edges of blocks_of: the arrays that a block runs on, pickled. `own` are its rows and `other` the rows outside
    that it looks at, in order of id; `row` and `to` (at < len(own) in own, else in other) and `weight` are its edges in order of row and
    rank; `told` and `by` are its rows that other blocks look at, and these blocks."""
    edges = edges.where("dst is not null")
    home = edges.select(F.col("src").alias("dst"), F.col("block").alias("home")).distinct()
    told = edges.select("dst", "block").distinct().join(home, "dst").where("home <> block")
    told = told.select("home", F.col("dst").alias("mine"), F.col("block").alias("by"))

    def pack(key: tuple, own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["src", "rank"])
        src, dst = own["src"].to_numpy(np.int64), own["dst"].to_numpy(np.int64)
        ids = np.unique(src)
        other = np.setdiff1d(dst, ids)
        held = {"own": ids, "other": other, "row": np.searchsorted(ids, src), "weight": own["weight"].to_numpy(np.float64)}
        inside = np.isin(dst, ids)
        held["to"] = np.where(inside, np.searchsorted(ids, dst), len(ids) + np.searchsorted(other, dst) + np.where(dst < src, 0, len(other)))
        held["told"], held["by"] = np.searchsorted(ids, told["mine"].to_numpy(np.int64)), told["by"].to_numpy(np.int64)
        return pd.DataFrame({"block": [key[0]], "held": [pickle.dumps(held)]})

    return edges.groupBy("block").cogroup(told.groupBy("home")).applyInPandas(pack, "block long, held binary")


def run_block(held: dict, seen: np.ndarray, passes: int, self_weight: float) -> np.ndarray:
    """Labels of a block's own rows before and after each pass, a line for each. `seen` are those known of its rows and of the others it
    looks at. A row sees what an edge's lower end became in the pass, and what its higher end was before it."""
    own = len(held["own"])
    ends, weight = held["to"].tolist(), held["weight"].tolist()
    first = np.searchsorted(held["row"], np.arange(own + 1)).tolist()
    lines = [seen[0, :own].tolist()]
    for p in range(1, passes + 1):
        label = lines[-1] + seen[p, own:].tolist() + seen[p - 1, own:].tolist()
        for i in range(own):
            total: dict[int, float] = {label[i]: self_weight} if self_weight > 0 else {}
            for at in range(first[i], first[i + 1]):
                x = label[ends[at]]
                total[x] = total.get(x, 0.0) + weight[at]
            label[i] = max(total, key=lambda x: (total[x], -x)) if len(total) > 1 else next(iter(total))
        lines.append(label[:own])
    return np.array(lines, np.int64)


def block_passes(edges: DataFrame, passes: int, self_weight: float = 0.0) -> DataFrame:
    """(id, label) of the rows that have edges, after passes in ascending order of id over the edges of blocks_of; labels are ids, not dense.

    A row carries its label before and after each pass. A block runs its own rows in order with what is known of the rows outside it,
    tells the blocks that look at them which of its rows have changed, and is run again when it is told of others. A row's label in a
    pass depends on lower rows of that pass and on the pass before only, so the labels that hold in the end are those of the passes:
    after as many rounds as there are pairs of block and pass at most, and mostly much earlier.

    Blocks stay in their partitions, only changes are shuffled, and a round is one small job without a plan: the driver keeps
    nothing of it but the number of changes.
    """
    packed = cut(packed_blocks(edges))
    spark, parts = edges.sparkSession, min(20_000, max(1, packed.count()))
    blocks = packed.rdd.map(lambda r: (r["block"], bytes(r["held"]))).partitionBy(parts).persist(StorageLevel.MEMORY_AND_DISK)

    def first(held: bytes) -> np.ndarray:
        ids = pickle.loads(held)
        return np.tile(np.concatenate([ids["own"], ids["other"]]), (passes + 1, 1))

    def run(group) -> tuple:
        held, (seen, ran), *news = (x for _, x in sorted(group, key=lambda x: x[0]))
        if ran and not news:
            return (seen, True), []
        held, seen = pickle.loads(held), seen.copy()
        own = len(held["own"])
        for ids, lines in news:
            seen[:, own + np.searchsorted(held["other"], ids)] = lines
        after = run_block(held, seen, passes, self_weight)
        changed = (after != seen[:, :own]).any(axis=0)
        seen[:, :own] = after
        told, by = (held[x][changed[held["told"]]] for x in ("told", "by"))
        return (seen, True), [(int(b), (held["own"][told[by == b]], after[:, told[by == b]])) for b in np.unique(by)]

    state = blocks.mapValues(lambda held: (first(held), False))
    news, done, rounds = spark.sparkContext.emptyRDD().partitionBy(parts), [], 0
    while True:
        met = blocks.mapValues(lambda x: (0, x)).union(state.mapValues(lambda x: (1, x))).union(news.mapValues(lambda x: (2, x)))
        after = met.groupByKey(parts).mapValues(run).persist(StorageLevel.MEMORY_AND_DISK)
        if rounds % 8 == 7:
            after.checkpoint()
        left = after.map(lambda x: len(x[1][1])).sum()
        state, news = after.mapValues(lambda x: x[0]), after.flatMap(lambda x: x[1][1]).partitionBy(parts)
        for old in done[:-1]:
            old.unpersist()
        done, rounds = [*done[-1:], after], rounds + 1
        if not left:
            break
    ends = blocks.join(state).flatMap(lambda x: zip(pickle.loads(x[1][0])["own"].tolist(), x[1][1][0][-1].tolist()))
    found = cut(spark.createDataFrame(ends, "id long, label long", verifySchema=False))
    for old in (*done, blocks):
        old.unpersist()
    return found


def relaxed_propagation(nodes: DataFrame, edges: DataFrame, iterations: int, self_weight: float = 0.0, size_penalty: float = 0.0) -> DataFrame:
    """(id, label) of label_propagation's passes, each as joins and aggregations over the edge table; labels are ids, not dense."""
    labels = cut(nodes.select("id", F.col("id").alias("label")))
    for _ in range(iterations):
        after = relaxed_pass(labels, edges, self_weight, size_penalty)
        labels = after.select("id", F.col("new").alias("label"))
        if not after.where("new <> label").limit(1).count():
            break
    return labels


def relaxed_pass(labels: DataFrame, edges: DataFrame, self_weight: float = 0.0, size_penalty: float = 0.0) -> DataFrame:
    """labels(id, label) with `new`, the labels after one pass in ascending order of id.

    In such a pass a row sees the new labels of lower rows and the old ones of higher rows. All rows are computed at once from what is
    known, then again those with a lower neighbour whose label has changed since, until nothing changes: rows depend on lower ones only,
    so the labels that then hold are those of the pass, and after r rounds all rows are right whose chains of lower neighbours
    are at most r long. A row's edges (edge_top at most) are one array, summed in order of rank as a loop would.
    """
    state = cut(labels.withColumn("new", F.col("label")))
    sized = labels.groupBy("label").agg(F.count("*").alias("_count")) if size_penalty > 0 else None
    todo = edges
    while True:
        ends = state.select(F.col("id").alias("dst"), F.col("label").alias("_old"), F.col("new").alias("_new"))
        seen = todo.join(ends, "dst").select("src", "rank", "weight", F.when(F.col("dst") < F.col("src"), F.col("_new")).otherwise(F.col("_old")).alias("l"))
        if self_weight > 0:
            own = todo.select("src").distinct().join(labels.select(F.col("id").alias("src"), F.col("label").alias("l")), "src")
            seen = seen.unionByName(own.select("src", F.lit(-1).alias("rank"), F.lit(float(self_weight)).alias("weight"), "l"))
        if sized is not None:
            seen = seen.join(sized.select(F.col("label").alias("l"), "_count"), "l", "left").withColumn("_count", F.coalesce("_count", F.lit(1)))
        else:
            seen = seen.withColumn("_count", F.lit(1))
        near = seen.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", "l", F.col("weight").cast("double").alias("w"), "_count"))).alias("_near"))

        def total(label):
            mine = F.filter("_near", lambda x: x["l"] == label)
            weight = F.aggregate(mine, F.lit(0.0), lambda a, x: a + x["w"])
            return F.struct((weight / F.pow(F.element_at(mine, 1)["_count"], F.lit(float(size_penalty))) if size_penalty > 0 else weight).alias("w"), (-label).alias("l"))

        best = (-F.array_max(F.transform(F.array_distinct(F.transform("_near", lambda x: x["l"])), total))["l"]).alias("_best")
        moved = cut(near.select(F.col("src").alias("id"), best).join(state, "id").where("_best <> new").select("id", "_best"))
        if not moved.limit(1).count():
            return state
        state = cut(state.join(moved, "id", "left").select("id", "label", F.coalesce("_best", "new").alias("new")))
        again = edges.join(moved.select(F.col("id").alias("dst")), "dst").where("src > dst").select("src").distinct()
        todo = edges.join(again, "src", "left_semi")


def synchronous_propagation(nodes: DataFrame, edges: DataFrame, iterations: int) -> DataFrame:
    """(id, label) after passes in which all rows see the labels of the pass before: a named variant that SQL can check."""
    labels = nodes.select("id", F.col("id").alias("label"))
    for _ in range(iterations):
        votes = edges.join(labels.select(F.col("id").alias("dst"), F.col("label").alias("l")), "dst").groupBy("src", "l").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("src").agg(F.max_by("l", F.struct(F.round("w", 9), -F.col("l"))).alias("new"))
        labels = cut(labels.join(best, labels["id"] == best["src"], "left").select("id", F.coalesce("new", "label").alias("label")))
    return labels


def split_oversized(labels: DataFrame, edges: DataFrame, max_size: int, edge_top: int) -> DataFrame:
    """(id, label): labels of more than max_size rows are split into the components of their inner edges of rank <= edge_top."""
    sized = cut(with_count(cut(labels), "label", "n"))  # each is read several times below; uncut, the plan outgrows the driver
    big = sized.where(F.col("n") > max_size).select("id", "label")
    inner = edges.where(F.col("rank") <= edge_top).join(big.select(F.col("id").alias("src"), "label"), "src").join(big.select(F.col("id").alias("dst"), F.col("label").alias("to")), "dst").where("label = to")
    parts = labelled_nodes(big, inner)
    out = sized.join(parts, "id", "left").select("id", F.struct("label", F.coalesce("component", F.lit(-1)).alias("part")).alias("label"))
    return dense(out)


def margins(knn: DataFrame, a: int, b: int) -> DataFrame:
    """(src, margin): score at rank a less score at rank b."""
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    return knn.groupBy("src").agg((at(a) - at(b)).alias("margin"))


def in_degree(knn: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(id, in_degree) over the first k neighbours; nodes that nobody names have 0."""
    n = knn.where(F.col("rank") <= k).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    return nodes.select("id").join(n, "id", "left").select("id", F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree"))


def mutual_margin_edges(knn: DataFrame, top: int, least: float) -> DataFrame:
    """Undirected (a, b) of rows that name each other and both have a margin of at least `least`."""
    m = margins(knn, 1, 2).where(F.col("margin") >= least).select("src")
    e = mutual(knn, top, top)
    e = e.join(m, "src", "left_semi").join(m.select(F.col("src").alias("dst")), "dst", "left_semi")
    return e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
