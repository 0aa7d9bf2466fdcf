"""Reports over rankings, scores, conditions and trials: what an evaluation prints, as small tables."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import graph, metrics, profile, vectors
from tessera.operators.profile import running_sums
from tessera.operators.quantiles import quantile_columns, quantiles
from tessera.operators.skew import unordered, with_count, with_group, within_blocks
from tessera.sources.lineage import cut


def row_scores(knn: DataFrame) -> DataFrame:
    """knn with `minmax` (within the row's scores) and `percentile` (1 for the first of the row, 0 for the last)."""
    w = Window.partitionBy("src")
    low, high, n = F.min("score").over(w), F.max("score").over(w), F.count("*").over(w)
    return knn.withColumns({"minmax": (F.col("score") - low) / F.greatest(high - low, F.lit(1e-6)), "percentile": (n - F.col("rank")) / F.greatest(n - 1, F.lit(1))})


def merged(left: DataFrame, right: DataFrame, keys: Sequence[str], suffixes: tuple[str, str]) -> DataFrame:
    """Inner join; columns other than the keys that both sides have get a suffix."""
    both = (set(left.columns) & set(right.columns)) - set(keys)
    named = lambda df, s: df.select([F.col(c).alias(c + s) if c in both else F.col(c) for c in df.columns])
    return named(left, suffixes[0]).join(named(right, suffixes[1]), list(keys))


def unordered_pairs(rows: DataFrame, owner: str, key: str, block: int = 2048) -> DataFrame:
    """(owner, left, right) of the pairs of one owner's rows, each once, the smaller key first. Its result is all pairs by definition;
    an owner's rows are dealt to blocks, so that no task has all of them."""
    return unordered(rows, owner, key, block)


def enum_place(value: Column, names: Sequence[str]) -> Column:
    """Place of a value in a list of names, from 0; unknown values and null come last."""
    at = F.array_position(F.array(*[F.lit(n) for n in names]), value)
    return F.when(F.coalesce(at, F.lit(0)) > 0, at - 1).otherwise(len(names)).cast("long")


def enrolment_cache(rows: DataFrame, owner: str, key: str, speaker: str, vector: str) -> DataFrame:
    """(owner, n, speakers, sources, v) of the rows enrolled under one name: how many speakers they name (more than one is an
    error), the sorted keys, and the mean unit vector."""
    from tessera.operators.vectors import pooled

    who = rows.groupBy(owner).agg(F.count("*").alias("n"), F.countDistinct(speaker).alias("speakers"), F.concat_ws(",", F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string"))).alias("sources"))
    return who.join(pooled(rows, owner, vector, last_unit=False).select(owner, "v"), owner)


def worst_queries(per_query: DataFrame, n: int) -> DataFrame:
    """The n queries of least precision; of equal ones those that find their first hit later."""
    return per_query.orderBy("p_at_k", F.desc("first_rank"), "src").limit(n)


def top_hubs(knn: DataFrame, nodes: DataFrame, k: int, n: int) -> DataFrame:
    """(id, in_degree, label) of the n rows that most rankings name."""
    return graph.in_degree(knn, nodes, k).orderBy(F.desc("in_degree"), "id").limit(n).join(nodes.select("id", "label"), "id")


def tail_diagnostics(knn: DataFrame, ranking: DataFrame, labels: DataFrame, k: int = 10, rank_top: int = 100, reciprocal_top: int = 20, sizes: tuple[int, int] = (2, 120), least_same: int = 1) -> DataFrame:
    """(src, margin, support, label_size, same_label, usable, confidence) of each row: how far the graph's labels can be trusted there.

    margin: score of the first less that of the k-th. support: of the first k, how many name the row among their first
    reciprocal_top. same_label: candidates of the row's label in the first rank_top of `ranking`, over the most there can be: confidence.
    """
    size = with_count(labels, "label", "label_size")
    own = size.select(F.col("id").alias("src"), F.col("label").alias("own"), "label_size")
    their = labels.select(F.col("id").alias("dst"), F.col("label").alias("their"))
    same = ranking.where(F.col("rank") <= rank_top).join(own, "src").join(their, "dst").groupBy("src").agg(F.count_if(F.col("own") == F.col("their")).alias("same_label"))
    support = graph.mutual(knn, k, reciprocal_top).groupBy("src").agg(F.count("*").alias("support"))
    out = graph.margins(knn, 1, k).join(own, "src").join(same, "src", "left").join(support, "src", "left")
    out = out.withColumns({"same_label": F.coalesce("same_label", F.lit(0)).cast("long"), "support": F.coalesce("support", F.lit(0)).cast("long")})
    usable = F.col("label_size").between(*sizes) & (F.col("same_label") >= least_same)
    most = F.greatest(F.least(F.col("label_size") - 1, F.lit(rank_top)), F.lit(1))
    return out.select("src", "margin", "support", "label_size", "same_label", usable.alias("usable"), (F.col("same_label") / most).alias("confidence"))


def stability(main: DataFrame, labels: DataFrame, variants: list[DataFrame], top: int) -> DataFrame:
    """(src, stability): mean over variants of the Jaccard similarity of two sets among the first `top` neighbours of `main`: those of
    the row's label, and those of its label in the variant. 1 where both are empty."""
    table = labels.select("id", F.array("label").alias("labels"))
    for named in variants:
        table = table.join(named.select("id", "label"), "id").select("id", F.concat("labels", F.array("label")).alias("labels"))
    return packed_stability(main, table, len(variants), top)


def packed_stability(main: DataFrame, labels: DataFrame, variants: int, top: int) -> DataFrame:
    """stability of labels(id, labels): an id's label and those in its variants as one array, so that each end is joined once."""
    near = main.where(F.col("rank") <= top).select("src", "dst")
    near = near.join(labels.select(F.col("id").alias("src"), F.col("labels").alias("_a")), "src").join(labels.select(F.col("id").alias("dst"), F.col("labels").alias("_b")), "dst")
    near = near.select("src", F.zip_with("_a", "_b", lambda a, b: a == b).alias("same"))
    parts = []
    for at in range(1, variants + 1):
        both, either = F.count_if(F.col("same")[0] & F.col("same")[at]), F.count_if(F.col("same")[0] | F.col("same")[at])
        parts.append(F.when(either == 0, F.lit(1.0)).otherwise(both / either))
    return near.groupBy("src").agg((sum(parts[1:], parts[0]) / len(parts)).alias("stability"))


def gallery_split(rows: DataFrame, owner: str, key: str, seed: str, share: float) -> DataFrame:
    """rows with `side`: of each owner `share` of its rows, one at least, are gallery, in hash order; the others are queries."""
    from tessera.functions.columns import hash_order

    w = Window.partitionBy(owner)
    r = F.row_number().over(w.orderBy(hash_order(seed, F.col(key))))
    return rows.withColumn("side", F.when(r <= F.greatest(F.lit(1), F.floor(F.count("*").over(w) * share)), "gallery").otherwise("query"))


def probability_losses(trials: DataFrame, probability: Column) -> DataFrame:
    """One row (brier, log_loss) of trials(label) under a probability, clamped to 1e-12 from either end."""
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), probability))
    y = F.col("label")
    return trials.select(((p - y) * (p - y)).alias("b"), (-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("l")).agg(F.avg("b").alias("brier"), F.avg("l").alias("log_loss"))


def hubness(knn: DataFrame, nodes: DataFrame, ks: Sequence[int]) -> DataFrame:
    """(k, p50, p95, p99, most, gini) of the in-degrees over the first k neighbours, for each k."""
    out = None
    for k in ks:
        degree = graph.in_degree(knn, nodes, k)
        ends = quantile_columns(degree, {"p50": ("in_degree", 0.5), "p95": ("in_degree", 0.95), "p99": ("in_degree", 0.99)})
        row = ends.join(degree.agg(F.max("in_degree").alias("most"))).join(metrics.gini(degree, "in_degree"))
        row = row.select(F.lit(k).cast("long").alias("k"), "p50", "p95", "p99", "most", "gini")
        out = row if out is None else out.unionByName(row)
    return out


def agreement_summary(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """One row: mean and median overlap, share of equal cells, of equal orders, sets and first places of two rankings."""
    a = metrics.agreement(left, right, k)
    share = lambda c: F.avg(F.col(c).cast("double"))
    return a.agg(F.avg("overlap").alias("mean_overlap"), F.percentile("overlap", F.lit(0.5)).alias("median_overlap"), (F.sum("same_cells") / (F.count("*") * k)).alias("same_cells"), share("same_order").alias("same_order"), share("same_set").alias("same_set"), share("same_top1").alias("same_top1"))


def drift(clean: DataFrame, distorted: DataFrame) -> DataFrame:
    """One row: mean and 95th percentile of cosine and distance between the two unit vectors of each id; both are (id, v)."""
    from tessera.functions.columns import dot, unit_vector

    both = clean.select("id", unit_vector(F.col("v")).alias("a")).join(distorted.select("id", unit_vector(F.col("v")).alias("b")), "id")
    apart = F.zip_with("a", "b", lambda x, y: x - y)
    s = both.select(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("a"), F.col("b")))).alias("cos"), F.sqrt(dot(apart, apart)).alias("l2"))
    s = cut(s)
    return s.agg(F.avg("cos").alias("cosine_mean"), F.avg("l2").alias("l2_mean")).join(quantile_columns(s, {"cosine_p95": ("cos", 0.95), "l2_p95": ("l2", 0.95)}))


def score_gaps(clean: DataFrame, distorted: DataFrame) -> DataFrame:
    """One row of two tables of the same trials (trial, label, score): mean distorted score of each class, their gap, and how it differs from the clean gap."""
    mean = lambda c, v: F.avg(F.when(F.col("label") == v, F.col(c)))
    both = clean.select("trial", "label", "score").join(distorted.select("trial", F.col("score").alias("now")), "trial")
    gap = lambda c: mean(c, 1) - mean(c, 0)
    return both.agg(mean("now", 1).alias("positive_mean_score"), mean("now", 0).alias("negative_mean_score"), gap("now").alias("separation_gap"), (gap("now") - gap("score")).alias("separation_gap_delta"))


def self_retrieval(clean: DataFrame, distorted: DataFrame) -> DataFrame:
    """One row (rows, self_retrieval_at1): how many distorted vectors (id, v) are nearest, by cosine, to the clean vector of their own id.

    Both sets are searched as one, with ids told apart, in the blocks of the exact search; of equal cosines the smallest id counts.
    """
    mine, other = (df.select((F.col("id") * 2 + i).alias("id"), "v") for i, df in ((0, clean), (1, distorted)))
    best = vectors.knn(other, 1, mine, "id", "v")
    found = best.agg(F.count("*").alias("rows"), F.avg((F.col("src") - 1 == F.col("dst")).cast("double")).alias("self_retrieval_at1"))
    return found


def degradation(conditions: DataFrame, clean: DataFrame) -> DataFrame:
    """conditions(model, condition, eer, min_dcf, ...) with `degradation`: half the relative growth of each rate over the model's
    clean row, no less than 0, denominators of at least 1e-6. clean(model, eer, min_dcf) has one row for each model."""
    base = F.broadcast(clean.select("model", F.col("eer").alias("_e"), F.col("min_dcf").alias("_d")))
    term = lambda now, then: F.greatest((F.col(now) - F.col(then)) / F.greatest(F.col(then), F.lit(1e-6)), F.lit(0.0))
    return conditions.join(base, "model").withColumn("degradation", 0.5 * term("eer", "_e") + 0.5 * term("min_dcf", "_d")).drop("_e", "_d")


def monotonicity(degraded: DataFrame, severities: Sequence[str]) -> DataFrame:
    """(model, family, <severity>..., is_monotonic): degradation by severity, and whether it never falls."""
    p = degraded.groupBy("model", "family").pivot("severity", list(severities)).agg(F.max("degradation"))
    steps = [F.coalesce(F.col(f"`{a}`") <= F.col(f"`{b}`"), F.lit(False)) for a, b in zip(severities, severities[1:], strict=False)]
    ok = steps[0]
    for s in steps[1:]:
        ok = ok & s
    return p.withColumn("is_monotonic", ok)


def paired(degraded: DataFrame, first: str, second: str) -> DataFrame:
    """(condition, second_better_eer, second_better_min_dcf, second_more_robust) of two models, condition by condition."""
    take = lambda m, s: degraded.where(F.col("model") == m).select("condition", *[F.col(c).alias(c + s) for c in ("eer", "min_dcf", "degradation")])
    both = take(first, "_1").join(take(second, "_2"), "condition")
    less = lambda c: F.col(f"{c}_2") < F.col(f"{c}_1")
    return both.select("condition", less("eer").alias("second_better_eer"), less("min_dcf").alias("second_better_min_dcf"), less("degradation").alias("second_more_robust"))


def regime_grid(rows: DataFrame, first: tuple[str, Sequence[str]], second: tuple[str, Sequence[str]], cluster: str, truth: str, margin: str) -> DataFrame:
    """One row for each pair of buckets, empty ones too: rows, pairwise purity (0 without pairs) and median margin (null without rows)."""
    (a, names_a), (b, names_b) = first, second
    spark = rows.sparkSession
    grid = spark.createDataFrame([(x, y) for x in names_a for y in names_b], f"{a} string, {b} string")
    pairs = lambda n: n * (n - 1) / 2
    cells = rows.groupBy(a, b, cluster, truth).agg(F.count("*").alias("n")).groupBy(a, b, cluster).agg(F.sum(pairs(F.col("n"))).alias("good"), pairs(F.sum("n")).alias("every"))
    purity = cells.groupBy(a, b).agg((F.sum("good") / F.nullif(F.sum("every"), F.lit(0.0))).alias("purity"))
    counts = rows.groupBy(a, b).agg(F.count("*").alias("rows"), F.percentile(margin, F.lit(0.5)).alias("median_margin"))
    out = grid.join(counts, [a, b], "left").join(purity, [a, b], "left")
    return out.select(a, b, F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), F.coalesce("purity", F.lit(0.0)).alias("purity"), "median_margin")


def resampled_place(sample: Column, draw: Column, n: Column) -> Column:
    """A reproducible place in 0..n-1 for a draw of a sample, by integer arithmetic that any engine repeats."""
    x = (sample * 7_919 + draw * 104_729 + sample * draw * 31 + 12_345) % 2_147_483_647
    return ((x * 48_271) % 2_147_483_647) % n


def bootstrap(values: DataFrame, value: str, order: list[Column], samples: int) -> DataFrame:
    """One row (mean, deviation, ci95_low, ci95_high): percentiles of the means of `samples` resamples, drawn with replacement.

    Rows are numbered by ranges; each draw joins the row it falls on, and means are sums with map-side combination.
    """
    rows = profile.numbered(values.where(F.col(value).isNotNull()), order, "place").select((F.col("place") - 1).alias("place"), F.col(value).alias("x"))
    n = rows.agg(F.count("*").alias("n"))
    draws = rows.select(F.col("place").alias("draw")).join(F.broadcast(n)).withColumn("sample", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(samples - 1).cast("long"))))
    draws = draws.select("sample", resampled_place(F.col("sample"), F.col("draw"), F.col("n")).alias("place"))
    means = draws.groupBy("sample", "place").agg(F.count("*").alias("times")).join(rows, "place").groupBy("sample").agg((F.sum(F.col("times") * F.col("x")) / F.sum("times")).alias("m"))
    ends = means.agg(F.percentile("m", F.lit(0.025)).alias("ci95_low"), F.percentile("m", F.lit(0.975)).alias("ci95_high"))
    return values.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation")).join(ends)


def signed_ranks(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, mean_delta, w_plus, w_minus, z, note) of the signed-rank test of a - b, zero differences left out, ties at their mean rank.

    z uses the normal approximation with the correction for ties. note: all_zero_deltas, or insufficient_overlap_for_wilcoxon
    below two rows. Equal magnitudes are counted first, so the running count goes over distinct magnitudes.
    """
    d = pairs.select((F.col(a) - F.col(b)).alias("d"))
    total = d.agg(F.count("*").alias("rows"), F.avg("d").alias("mean_delta"))
    by = d.where("d <> 0").groupBy(F.abs("d").alias("m")).agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("plus"))
    by = running_sums(by, [F.asc("m")], {"before": "t"}, earlier=True).withColumn("rank", F.col("before") + (F.col("t") + 1) / 2)
    s = by.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("plus") * F.col("rank")), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum((F.col("t") - F.col("plus")) * F.col("rank")), F.lit(0.0)).alias("w_minus"), F.coalesce(F.sum(F.pow(F.col("t").cast("double"), F.lit(3)) - F.col("t")), F.lit(0.0)).alias("ties")).join(total)
    spread = F.sqrt((F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) - F.col("ties") / 2) / 24)
    z = (F.least("w_plus", "w_minus") - F.col("n") * (F.col("n") + 1) / 4) / F.nullif(spread, F.lit(0.0))
    note = F.when(F.col("n") == 0, "all_zero_deltas").when(F.col("rows") < 2, "insufficient_overlap_for_wilcoxon").otherwise("ok")
    return s.select("n", "mean_delta", "w_plus", "w_minus", z.alias("z"), note.alias("note"))


def two_sided(z: float) -> float:
    """The p value of a normal score."""
    return math.erfc(abs(z) / math.sqrt(2))


def round_gate(teacher: DataFrame, student: DataFrame, k: int, overlap_gate: float, gain_gate: float) -> DataFrame:
    """One row (overlap, margin_gain, passes): mean share of common neighbours, median gain of the margin between the first two."""
    a = metrics.agreement(teacher, student, k).agg(F.avg(F.col("overlap") / k).alias("overlap"))
    t, s = graph.margins(teacher, 1, 2), graph.margins(student, 1, 2).withColumnRenamed("margin", "after")
    gain = quantiles(t.join(s, "src"), F.col("after") - F.col("margin"), [0.5]).select(F.col("value").alias("margin_gain"))
    return a.join(gain).withColumn("passes", (F.col("overlap") < overlap_gate) | (F.col("margin_gain") >= gain_gate))


def trial_summary(scored: DataFrame) -> DataFrame:
    """One row of scored(label, score): trials, those without a score, and by class the mean score, and their gap."""
    mean = lambda v: F.avg(F.when(F.col("label") == v, F.col("score")))
    return scored.agg(F.count("*").alias("trials"), F.count_if(F.col("score").isNull()).alias("missing"), mean(1).alias("positive_mean"), mean(0).alias("negative_mean"), (mean(1) - mean(0)).alias("gap"))


def pool_alignment(rows: DataFrame, local: Column, names: Sequence[str]) -> DataFrame:
    """(metric, local_mean, public_mean, mean_gap, local_deviation, public_deviation) of two pools of one table, in one pass."""
    side = lambda c, x: F.when(local if x else ~local, F.col(c))
    s = rows.agg(*[f(side(c, x)).alias(f"{c}_{n}{int(x)}") for c in names for x in (True, False) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    return s.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"{c}_m1").alias("local_mean"), F.col(f"{c}_m0").alias("public_mean"), (F.col(f"{c}_m1") - F.col(f"{c}_m0")).alias("mean_gap"), F.col(f"{c}_s1").alias("local_deviation"), F.col(f"{c}_s0").alias("public_deviation")) for c in names])))


def cohesion(rows: DataFrame, q: float = 0.1, cells: int = 16_384, block: int = 4096) -> DataFrame:
    """(label, pairs, mean, deviation, least, p10) of the cosines of each label's pairs of rows(id, label, v), `q` being p10's.

    Blocks of a label's rows are multiplied by each other and no pair is written: a first pass counts scores by cell, which tells the
    cells that hold the quantile's places, and a second one gives out the scores in these, equal ones once with their number. Scores
    are null, and only counted as pairs, where a vector is null, has no length or holds null or non-finite components.
    """
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    dealt, parts = within_blocks(rows.where("id is not null").select("id", "label", F.when(~bad, F.col("v").cast("array<double>")).alias("v")), "label", "id", block)
    kind = dealt.select("label").schema["label"].dataType.simpleString()

    def products(group: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
        """The number of pairs and their known scores, slice by slice. Rows are ordered, so that both passes see the same scores."""
        ids, i, j = group["id"].to_numpy(), group["_i"][0].as_py(), group["_j"][0].as_py()
        v = group["v"].combine_chunks()
        there = v.is_valid().to_numpy(zero_copy_only=False)
        flat = v.drop_null().flatten().to_numpy(zero_copy_only=False)
        x = np.zeros((len(ids), len(flat) // max(1, there.sum())))
        x[there] = flat.reshape(there.sum(), -1) if there.any() else 0
        length = np.sqrt((x * x).sum(axis=1))
        there = length > 0
        x /= np.where(there, length, 1)[:, None]
        order = np.argsort(ids, kind="stable")
        own = group["_own"].to_numpy()[order]
        a, b = order[own == i], order[own == j]
        for at in range(0, len(a), 512):
            some = a[at : at + 512]
            score = np.clip(x[some] @ x[b].T, -1, 1)
            counted = np.ones(score.shape, bool) if i != j else np.arange(len(b)) >= np.searchsorted(ids[b], ids[some], "right")[:, None]
            yield int(counted.sum()), score[counted & there[some][:, None] & there[b]]

    def cell(score: np.ndarray) -> np.ndarray:
        return np.minimum(((score + 1) * (cells / 2)).astype(np.int64), cells - 1)

    def counts(group: pa.Table) -> pa.Table:
        pairs, n, mean, square, least, held = 0, 0, 0.0, 0.0, None, np.zeros(cells, np.int64)
        for some, score in products(group):
            pairs += some
            if len(score):
                own, step = float(score.mean()), float(score.mean()) - mean
                square += float(((score - own) ** 2).sum()) + step * step * n * len(score) / (n + len(score))
                mean += step * len(score) / (n + len(score))
                n, least = n + len(score), min(float(score.min()), 1.0 if least is None else least)
                held += np.bincount(cell(score), minlength=cells)
        at = np.flatnonzero(held)
        row = {"label": group["label"][:1], "pairs": [pairs], "n": [n], "mean": [mean], "square": [square], "least": pa.array([least], pa.float64())}
        return pa.table(row | {"cell": pa.array([at.tolist()], pa.list_(pa.int64())), "held": pa.array([held[at].tolist()], pa.list_(pa.int64()))})

    def inside(group: pa.Table) -> pa.Table:
        first, last = group["_first"][0].as_py(), group["_last"][0].as_py()
        found = [s[(cell(s) >= first) & (cell(s) <= last)] for _, s in products(group)]
        value, n = np.unique(np.concatenate([np.zeros(0), *found]), return_counts=True)
        return pa.table({"label": pa.array([group["label"][0].as_py()] * len(value), group.schema.field("label").type), "value": value, "n": n.astype(np.int64)})

    by = ["label", "_i", "_j"]
    met = cut(dealt.repartition(parts, *by).groupBy(*by).applyInArrow(counts, f"label {kind}, pairs long, n long, mean double, square double, least double, cell array<long>, held array<long>")).where("pairs > 0")
    mean = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    whole = cut(met.groupBy("label").agg(F.sum("pairs").alias("pairs"), F.sum("n").alias("n"), F.when(F.sum("n") > 0, mean).alias("mean"), F.min("least").alias("least")))
    about = met.join(whole.select("label", F.col("mean").alias("_mean")), "label").groupBy("label").agg(F.sum(F.col("square") + F.col("n") * F.pow(F.col("mean") - F.col("_mean"), F.lit(2.0))).alias("square"))
    w = Window.partitionBy("label")
    held = met.select("label", F.inline(F.arrays_zip("cell", "held"))).groupBy("label", "cell").agg(F.sum("held").alias("held"))
    held = held.withColumns({"_to": F.sum("held").over(w.orderBy("cell")), "_at": q * (F.sum("held").over(w) - 1)})
    low, high = F.col("_to") > F.floor("_at"), F.col("_to") > F.ceil("_at")
    bounds = cut(held.groupBy("label").agg(F.min(F.when(low, F.col("cell"))).alias("_first"), F.min(F.when(high, F.col("cell"))).alias("_last"), F.min(F.when(low, F.col("_to") - F.col("held"))).alias("_before"), F.max("_at").alias("_at"), F.max("_to").alias("_all")))
    wanted = with_group(dealt, bounds, "label", "_all", bounds.agg(F.sum("_all")).first()[0] or 0)
    values = wanted.repartition(parts, *by).groupBy(*by).applyInArrow(inside, f"label {kind}, value double, n long").groupBy("label", "value").agg(F.sum("n").alias("n"))
    values = values.withColumn("_run", F.sum("n").over(w.orderBy("value"))).join(bounds, "label").withColumn("_to", F.col("_before") + F.col("_run"))
    lo, hi = F.min(F.when(low, F.col("value"))), F.min(F.when(high, F.col("value")))
    ends = values.groupBy("label").agg((lo + (hi - lo) * F.first(F.col("_at") - F.floor("_at"))).alias("p10"))
    deviation = F.when(F.col("n") > 0, F.sqrt(F.col("square") / F.col("n")))
    return whole.join(about, "label", "left").join(ends, "label", "left").select("label", "pairs", "mean", deviation.alias("deviation"), "least", "p10")


def speaker_quality(per_query: DataFrame) -> DataFrame:
    """(label, queries, mean_p, mean_top1, mean_first_rank)."""
    return per_query.groupBy("label").agg(F.count("*").alias("queries"), F.avg("p_at_k").alias("mean_p"), F.avg("top1_score").alias("mean_top1"), F.avg("first_rank").alias("mean_first_rank"))


def usage(routed: DataFrame) -> DataFrame:
    """(policy, rows, share) of routed(policy)."""
    return routed.groupBy("policy").agg(F.count("*").alias("rows")).withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy()))


def policy_overlap(overlaps: DataFrame) -> DataFrame:
    """(policy, mean, p50, p10) of overlaps(policy, src, overlap)."""
    return overlaps.groupBy("policy").agg(F.avg("overlap").alias("mean"), F.percentile("overlap", F.lit(0.5)).alias("p50"), F.percentile("overlap", F.lit(0.1)).alias("p10"))


def runtime(stages: DataFrame, stage: str, seconds: str, audio: str) -> DataFrame:
    """(stage, items, seconds, items_per_second, real_time_factor) of each stage and of all together (stage null)."""
    out = stages.rollup(stage).agg(F.count("*").alias("items"), F.sum(seconds).alias("seconds"), F.sum(audio).alias("audio"))
    return out.select(stage, "items", "seconds", (F.col("items") / F.nullif(F.col("seconds"), F.lit(0.0))).alias("items_per_second"), (F.col("seconds") / F.nullif(F.col("audio"), F.lit(0.0))).alias("real_time_factor"))


def parity(online: DataFrame, offline: DataFrame, keys: Sequence[str], item: str, value: str, within: float) -> DataFrame:
    """(item, cells, most, same): the largest difference of two tables of cells, and whether it stays within the tolerance; a cell that one side lacks fails."""
    a, b = (df.select(*keys, F.col(value).alias(n)) for df, n in ((online, "a"), (offline, "b")))
    both = a.join(b, list(keys), "full").groupBy(item).agg(F.count("*").alias("cells"), F.max(F.abs(F.col("a") - F.col("b"))).alias("most"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("lone"))
    return both.select(item, "cells", "most", ((F.col("most") <= within) & (F.col("lone") == 0)).alias("same"))


def role_trials(rows: DataFrame, key: str, speaker: str, role: str, block: int = 2048) -> DataFrame:
    """(left, right, label): every enrolment row against every test row other than itself; without either role, all unordered pairs.

    Both sides are dealt to blocks, and a block of one meets a block of the other once: the result is a product by definition, but no
    side is broadcast, no key is hot and no task has more than its share of the blocks.
    """
    sides = {r: rows.where(F.col(role) == r).select(F.col(key).alias("k"), F.col(speaker).alias("s")) for r in ("enrollment", "test")}
    same = (F.col("s_a") == F.col("s_b")).cast("int").alias("label")
    if not all(df.limit(1).count() for df in sides.values()):
        return unordered(rows.select(F.col(key).alias("k"), F.col(speaker).alias("s")), None, "k", block, ("s",)).select("left", "right", same)
    a, b = (df.select(F.col("k").alias(f"k_{end}"), F.col("s").alias(f"s_{end}")) for df, end in zip(sides.values(), "ab", strict=True))
    return vectors.in_blocks(a, b, "k_a", "k_b", block).where("k_a <> k_b").select(F.col("k_a").alias("left"), F.col("k_b").alias("right"), same)


def distortion_plan(manifest: DataFrame, key: str, conditions: list[tuple[str, str, str]]) -> DataFrame:
    """(key, condition, family, severity, seed): each row under each condition of a fixed catalogue; seeds by sha256."""
    catalogue = manifest.sparkSession.createDataFrame(conditions, "condition string, family string, severity string")
    out = manifest.select(key).join(F.broadcast(catalogue))
    return out.withColumn("seed", F.substring(F.sha2(F.concat_ws("|", F.col("condition"), F.col(key).cast("string")), 256), 1, 8))


def hash_unit(*key: Column) -> Column:
    """A number in [0, 1) from the first 12 hexadecimal digits of a sha256, the same in any engine."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[k.cast("string") for k in key]), 256), 1, 12), 16, 10).cast("double") / float(1 << 48)


def augmentation_schedule(rows: DataFrame, key: str, epoch: int, ramp: tuple[int, float, float], families: list[tuple[str, float]], seed: str) -> DataFrame:
    """(key, family) of one epoch: null where a row stays as it is. The share of augmented rows ramps from the first to the second
    value of `ramp` over its number of epochs; families are drawn by weight, through their cumulative shares."""
    length, low, high = ramp
    share = low + (high - low) * min(1.0, epoch / max(length, 1))
    total, upto, pick = sum(w for _, w in families), 0.0, F
    u = hash_unit(F.lit(seed), F.lit("family"), F.lit(epoch), F.col(key))
    for name, w in families:
        upto += w / total
        pick = pick.when(u < upto, name)
    family = F.when(hash_unit(F.lit(seed), F.lit("any"), F.lit(epoch), F.col(key)) < share, pick.otherwise(families[-1][0]))
    return rows.select(key, family.alias("family"))


def acoustic_prior(sample: DataFrame, reference: DataFrame, owner: str, names: Sequence[str], weight: dict[str, float], distance_q: float, diversity_q: float, least: int) -> dict:
    """Centre (median of the sample), scale (population deviation of the reference, at least 1e-6), the quantile of the sample's
    weighted distances, and the quantile of its owners' weighted diversities (owners of at least `least` rows). A few numbers."""
    from tessera.functions.columns import weighted_distance

    mid = quantile_columns(sample, {n: (n, 0.5) for n in names}).first().asDict()
    scale = {n: max(float(v or 0.0), 1e-6) for n, v in reference.agg(*[F.stddev_pop(n).alias(n) for n in names]).first().asDict().items()}
    mid = {n: float(v) for n, v in mid.items()}
    far = quantiles(sample, weighted_distance(names, mid, scale, weight), [distance_q]).first()["value"]
    spread = sum((weight[n] * F.stddev_pop(n) / scale[n] for n in names[1:]), weight[names[0]] * F.stddev_pop(names[0]) / scale[names[0]])
    floor = sample.groupBy(owner).agg(F.count("*").alias("n"), spread.alias("d")).where(F.col("n") >= least).agg(F.percentile("d", F.lit(diversity_q))).first()[0]
    return {"centre": mid, "scale": scale, "weight": weight, "distance": float(far), "diversity": float(floor or 0.0)}


def prior_selected(components: DataFrame, features: DataFrame, prior: dict, order: str, sizes: tuple[int, int], cap: int) -> DataFrame:
    """(id, component, distance, diversity) of components(id, component) whose size lies between the bounds, whose median feature
    distance does not exceed the prior's and whose diversity reaches its floor; of each the first `cap` rows by `order`, then id."""
    from tessera.functions.columns import weighted_distance

    names = list(prior["centre"])
    x = components.join(features, "id").withColumn("_d", weighted_distance(names, prior["centre"], prior["scale"], prior["weight"]))
    spread = sum((prior["weight"][n] * F.stddev_pop(n) / prior["scale"][n] for n in names[1:]), prior["weight"][names[0]] * F.stddev_pop(names[0]) / prior["scale"][names[0]])
    good = x.groupBy("component").agg(F.count("*").alias("n"), F.percentile("_d", F.lit(0.5)).alias("distance"), spread.alias("diversity"))
    good = good.where(F.col("n").between(*sizes) & (F.col("distance") <= prior["distance"]) & (F.col("diversity") >= prior["diversity"]))
    place = F.row_number().over(Window.partitionBy("component").orderBy(order, "id"))
    return x.join(good, "component").withColumn("_r", place).where(F.col("_r") <= cap).select("id", "component", "distance", "diversity")


def soft_metadata(soft: DataFrame, classes: DataFrame) -> DataFrame:
    """(src, class_index, probs): soft labels(src, label, prob, place) as two lists in order of place; classes(label, at) numbers the labels."""
    s = soft.join(classes, "label").groupBy("src").agg(F.array_sort(F.collect_list(F.struct("place", "at", "prob"))).alias("s"))
    return s.select("src", F.transform("s", lambda x: x["at"]).alias("class_index"), F.transform("s", lambda x: x["prob"]).alias("probs"))


def teacher_confidence(agreement: DataFrame, margin: DataFrame, density: DataFrame, stable: DataFrame) -> DataFrame:
    """(src, confidence) of four tables (src, value in 0..1): 0.40 agreement, 0.25 margin, 0.20 density, 0.15 stability."""
    weights = {"agreement": 0.40, "margin": 0.25, "density": 0.20, "stable": 0.15}  # Fixed values.
    out = None
    for (name, w), df in zip(weights.items(), (agreement, margin, density, stable), strict=True):
        part = df.select("src", (w * F.col("value")).alias(name))
        out = part if out is None else out.join(part, "src", "full")
    return out.select("src", sum((F.coalesce(n, F.lit(0.0)) for n in list(weights)[1:]), F.coalesce("agreement", F.lit(0.0))).alias("confidence"))
