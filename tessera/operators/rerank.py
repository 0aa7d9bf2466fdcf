"""Re-ranking, fusion and routing of neighbour tables. Rankings carry (src, dst, rank, score)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.sources.lineage import cut
from tessera.operators.skew import with_count


def ranked(df: DataFrame, order: list[Column], k: int | None = None, by: str = "src") -> DataFrame:
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return out if k is None else out.where(F.col("rank") <= k)


def adjusted_ranking(knn: DataFrame, rank_top: int = 100, reciprocal_top: int = 20, bonus: float = 0.03, penalty: float = 0.02) -> DataFrame:
    """Order by score + bonus for reciprocal rows - penalty * density of the neighbour; the score given out is the original one."""
    near = knn.where(F.col("rank") <= rank_top)
    back = knn.where(F.col("rank") <= reciprocal_top).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1.0).alias("back"))
    z = graph.density_z(knn).select(F.col("id").alias("dst"), "z")
    out = near.join(back, ["src", "dst"], "left").join(z, "dst").withColumn("adjusted", F.col("score") + bonus * F.coalesce("back", F.lit(0.0)) - penalty * F.col("z"))
    return ranked(out.select("src", "dst", "score", "adjusted"), [F.desc(F.round("adjusted", 12)), F.asc("dst")])


def prefer_group(ranking: DataFrame, groups: DataFrame, k: int, least_size: int, most_size: int, least_candidates: int) -> DataFrame:
    """Candidates of a row's own group first, then the others, each in ranking order, where the group's size lies between the
    bounds and enough candidates belong to it; otherwise the ranking as it is. groups(id, label)."""
    sized = with_count(groups, "label", "n")
    own = sized.select(F.col("id").alias("src"), F.col("label").alias("own"), "n")
    other = groups.select(F.col("id").alias("dst"), F.col("label").alias("their"))
    both = ranking.join(own, "src").join(other, "dst").withColumn("same", F.col("own") == F.col("their"))
    usable = F.col("n").between(least_size, most_size) & (F.count_if("same").over(Window.partitionBy("src")) >= least_candidates)
    both = both.withColumn("late", F.when(usable & F.col("same"), 0).otherwise(1)).withColumnRenamed("rank", "before")
    return ranked(both, [F.asc("late"), F.asc("before")], k).select("src", "dst", "rank", "score")


def community_rerank(knn: DataFrame, nodes: DataFrame, k: int = 10, edge_top: int = 10, reciprocal_top: int = 20, rank_top: int = 100, sizes: tuple[int, int] = (11, 120), least_candidates: int = 6) -> DataFrame:
    parts = graph.labelled_nodes(nodes, graph.mutual(knn, edge_top, reciprocal_top)).withColumnRenamed("component", "label")
    return prefer_group(adjusted_ranking(knn, rank_top, reciprocal_top), parts, k, *sizes, least_candidates)


def propagation_rerank(knn: DataFrame, nodes: DataFrame, k: int = 10, edge_top: int = 10, reciprocal_top: int = 20, rank_top: int = 100, iterations: int = 5, sizes: tuple[int, int] = (5, 120), least_candidates: int = 3) -> DataFrame:
    edges = graph.mutual(knn, edge_top, reciprocal_top).withColumn("weight", F.col("score"))
    labels = cut(graph.label_propagation(nodes, edges, iterations))  # prefer_group reads them several times
    return prefer_group(adjusted_ranking(knn, max(rank_top, k), reciprocal_top), labels, k, *sizes, least_candidates)


def cluster_first(knn: DataFrame, nodes: DataFrame, k: int = 10, edge_top: int = 20, reciprocal_top: int = 40, rank_top: int = 60, iterations: int = 8, sizes: tuple[int, int] = (11, 220), least_candidates: int = 6, split_top: int | None = 12, **weights) -> tuple[DataFrame, DataFrame]:
    """The re-ranked table, and the clusters (id, label) behind it."""
    edges = cut(graph.cluster_edges(knn, edge_top, reciprocal_top, **weights))
    labels = graph.label_propagation(nodes, edges, iterations)
    if split_top is not None:
        labels = graph.split_oversized(labels, edges, sizes[1], split_top)
    labels = cut(labels)
    return prefer_group(adjusted_ranking(knn, rank_top, reciprocal_top), labels, k, *sizes, least_candidates), labels


def class_overlap(pairs: DataFrame, classes: DataFrame, top: int | None = None) -> DataFrame:
    """pairs(src, dst, ...) with `overlap`: the sum over shared classes of the product of their probabilities."""
    c = classes if top is None else classes.where(F.col("class_rank") <= top)
    a = pairs.select("src", "dst").join(c.select(F.col("id").alias("src"), "class_id", F.col("prob").alias("p")), "src")
    both = a.join(c.select(F.col("id").alias("dst"), "class_id", F.col("prob").alias("q")), ["dst", "class_id"])
    s = both.groupBy("src", "dst").agg(F.sum(F.col("p") * F.col("q")).alias("overlap"))
    return pairs.join(s, ["src", "dst"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))


def first_class(classes: DataFrame, name: str, key: str) -> DataFrame:
    return classes.where("class_rank = 1").select(F.col("id").alias(key), F.col("class_id").alias(name))


def class_adjusted(knn: DataFrame, classes: DataFrame, top: int = 3, weight: float = 0.08, same_bonus: float = 0.03, query_bonus: float = 0.01) -> DataFrame:
    """Scores raised by class overlap, by an equal first class and by the candidate's first class among the query's; the
    raised scores order the rows and are given out."""
    out = class_overlap(knn, classes, top).join(first_class(classes, "own", "src"), "src").join(first_class(classes, "their", "dst"), "dst")
    among = classes.where(F.col("class_rank") <= top).select(F.col("id").alias("src"), F.col("class_id").alias("their"), F.lit(1.0).alias("among"))
    out = out.join(among, ["src", "their"], "left")
    score = F.col("score") + weight * F.col("overlap") + same_bonus * (F.col("own") == F.col("their")).cast("double") + query_bonus * F.coalesce("among", F.lit(0.0))
    return ranked(out.withColumn("score", score), [F.desc(F.round("score", 12)), F.asc("dst")]).select("src", "dst", "rank", "score")


@dataclass(frozen=True)
class ClassFirst:
    k: int = 10
    fallback_classes: int = 3
    least: int = 3
    most: int = 600
    embedding: float = 0.5
    overlap: float = 0.35
    same: float = 0.15
    rank_bonus: float = 0.03
    backfill: bool = True


def class_first(knn: DataFrame, classes: DataFrame, vectors: DataFrame, p: ClassFirst = ClassFirst()) -> DataFrame:
    """Candidates whose first class is among the query's first ones, best first; then the neighbours that are left.

    Where too few neighbours qualify, members of these classes are added, most probable first, class after class until there are
    `most`; of more than that the nearest stay.
    """
    from tessera.operators.vectors import cosine

    knn, classes = cut(knn), cut(classes)  # each is read many times below; uncut, the plan outgrows the driver
    mine = classes.where(F.col("class_rank") <= p.fallback_classes).select(F.col("id").alias("src"), F.col("class_id").alias("their"), "class_rank")
    fits = knn.join(first_class(classes, "their", "dst"), "dst").join(mine, ["src", "their"]).select("src", "dst", F.col("rank").alias("near"))
    fits = cut(fits)
    n = fits.groupBy("src").agg(F.count("*").alias("n"))
    queries = cut(knn.select("src").distinct().join(n, "src", "left").withColumn("n", F.coalesce("n", F.lit(0))))
    if p.backfill:
        by = Window.partitionBy("class_id").orderBy(F.desc("prob"), "id")
        bucket = classes.where("class_rank = 1").withColumn("place", F.row_number().over(by)).where(F.col("place") <= p.most)
        more = queries.where(F.col("n") < p.least).select("src").join(mine, "src").join(bucket.select(F.col("class_id").alias("their"), F.col("id").alias("dst"), "place"), "their").where("src <> dst")
        more = cut(more.join(fits, ["src", "dst"], "left_anti"))
        sizes = more.groupBy("src", "class_rank").agg(F.count("*").alias("own")).join(queries, "src")
        before = F.coalesce(F.sum("own").over(Window.partitionBy("src").orderBy("class_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        wanted = sizes.withColumn("before", F.col("n") + before).where(F.col("before") < p.most).select("src", "class_rank")
        more = more.join(wanted, ["src", "class_rank"]).select("src", "dst", F.lit(None).cast("int").alias("near"))
        fits = fits.unionByName(more)
    v = vectors.select(F.col("id"), "v")
    scored = fits.join(v.select(F.col("id").alias("src"), F.col("v").alias("a")), "src").join(v.select(F.col("id").alias("dst"), F.col("v").alias("b")), "dst").withColumn("cos", cosine(F.col("a"), F.col("b"))).drop("a", "b")
    scored = ranked(scored, [F.desc("cos"), F.asc("dst")]).join(queries, "src").where((F.col("rank") <= p.most) | (F.col("n") >= p.least)).drop("rank", "n")
    scored = class_overlap(cut(scored), classes).join(first_class(classes, "own", "src"), "src").join(first_class(classes, "their", "dst"), "dst")
    score = p.embedding * F.col("cos") + p.overlap * F.col("overlap") + p.same * (F.col("own") == F.col("their")).cast("double") + F.coalesce(p.rank_bonus / F.col("near"), F.lit(0.0))
    chosen = scored.withColumn("score", score).withColumn("held", F.count("*").over(Window.partitionBy("src"))).where(F.col("held") >= p.least).select("src", "dst", "score", F.lit(0).alias("late"), F.lit(0).alias("near"))
    rest = knn.join(chosen, ["src", "dst"], "left_anti").select("src", "dst", "score", F.lit(1).alias("late"), F.col("rank").alias("near"))
    order = [F.asc("late"), F.asc("near"), F.desc(F.round("score", 12)), F.asc("dst")]
    return ranked(chosen.unionByName(rest), order, p.k).select("src", "dst", "rank", "score")


def robust_z(knn: DataFrame, low: float, high: float) -> DataFrame:
    """knn with `z`: (score - median) / interquartile range of the row's scores, clipped."""
    q = knn.groupBy("src").agg(F.percentile("score", F.lit(0.5)).alias("m"), F.greatest(F.percentile("score", F.lit(0.75)) - F.percentile("score", F.lit(0.25)), F.lit(1e-6)).alias("s"))
    return knn.join(q, "src").withColumn("z", F.greatest(F.lit(low), F.least(F.lit(high), (F.col("score") - F.col("m")) / F.col("s")))).drop("m", "s")


def fuse(sources: list[tuple[DataFrame, float]], k: int, source_top: int, rank_weight: float = 0.7, z_weight: float = 0.3, z_clip: tuple[float, float] = (-3.0, 3.0)) -> DataFrame:
    """Sum over sources of weight * max(rank part + robust score part, 0); the fused score orders the rows, then smaller dst."""
    parts = None
    for knn, weight in sources:
        near = robust_z(knn.where(F.col("rank") <= source_top), *z_clip)
        held = F.greatest(F.count("*").over(Window.partitionBy("src")) - 1, F.lit(1))
        own = rank_weight * (1 - (F.col("rank") - 1) / held) + z_weight * F.col("z")
        near = near.where("src <> dst").select("src", "dst", (weight * F.greatest(own, F.lit(0.0))).alias("score"))
        parts = near if parts is None else parts.unionByName(near)
    total = parts.groupBy("src", "dst").agg(F.sum("score").alias("score"))
    return ranked(total, [F.desc(F.round("score", 12)), F.asc("dst")], k)


def teacher_part(knn: DataFrame, weight: float, top: int, reciprocal: float = 0.03, hub_penalty: float = 0.02) -> DataFrame:
    """(src, dst, part): what one teacher adds to a fused score: z score within the row, rank part, reciprocity, hub penalty."""
    near = knn.where(F.col("rank") <= top)
    w = Window.partitionBy("src")
    near = near.withColumn("z", (F.col("score") - F.avg("score").over(w)) / F.greatest(F.stddev_pop("score").over(w), F.lit(1e-6)))
    back = near.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1.0).alias("back"))
    deg = near.groupBy("dst").agg(F.log1p(F.count("*")).alias("h"))
    s = deg.agg(F.avg("h").alias("hm"), F.greatest(F.stddev_pop("h"), F.lit(1e-6)).alias("hs"))
    hub = deg.join(F.broadcast(s)).select("dst", ((F.col("h") - F.col("hm")) / F.col("hs")).alias("hub"))
    near = near.join(back, ["src", "dst"], "left").join(hub, "dst")
    own = 0.1 * F.col("z") + F.col("score") + 0.2 / F.sqrt("rank") + reciprocal * F.coalesce("back", F.lit(0.0)) - hub_penalty * F.col("hub")
    return near.select("src", "dst", (weight * own).alias("part"))


def fuse_teachers(sources: list[tuple[DataFrame, float]], k: int, top: int, agreement: float = 0.05, reciprocal: float = 0.03, hub_penalty: float = 0.02) -> DataFrame:
    """Fusion of several teachers: the sum of their parts, and a bonus for each further teacher that names the pair. Order: score,
    number of teachers, smaller dst."""
    return fuse_without(sources, k, top, agreement, reciprocal, hub_penalty, each=False).drop("variant")


def fuse_without(sources: list[tuple[DataFrame, float]], k: int, top: int, agreement: float = 0.05, reciprocal: float = 0.03, hub_penalty: float = 0.02, each: bool = True) -> DataFrame:
    """(variant, src, dst, rank, score, seen): fuse_teachers of all sources as variant 0 and, with `each`, of all but the n-th (from 1) as
    variant n. A source's parts do not depend on the others: they are computed once and all variants are summed together."""
    parts = None
    for n, (knn, weight) in enumerate(sources, 1):
        variants = [v for v in range(len(sources) + 1 if each else 1) if v != n]
        own = teacher_part(knn, weight, top, reciprocal, hub_penalty).select(F.explode(F.array(*[F.lit(v) for v in variants])).alias("variant"), "src", "dst", "part")
        parts = own if parts is None else parts.unionByName(own)
    total = parts.groupBy("variant", "src", "dst").agg(F.sum("part").alias("part"), F.count("*").alias("seen")).withColumn("score", F.col("part") + agreement * (F.col("seen") - 1))
    w = Window.partitionBy("variant", "src").orderBy(F.desc(F.round("score", 12)), F.desc("seen"), F.asc("dst"))
    return total.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("variant", "src", "dst", "rank", "score", "seen")


def consensus(candidates: DataFrame, k: int) -> DataFrame:
    """(policy, src, consensus) of candidates(policy, src, dst, ...): mean vote of its k rows over all policies."""
    n = candidates.select("policy").distinct().agg(F.count("*").alias("policies"))
    votes = candidates.withColumn("votes", F.count("*").over(Window.partitionBy("src", "dst")))
    return votes.groupBy("policy", "src").agg(F.sum("votes").alias("v")).join(F.broadcast(n)).select("policy", "src", (F.col("v") / (k * F.col("policies"))).alias("consensus"))


def overlaps(candidates: DataFrame, reference: str) -> DataFrame:
    """(policy, src, overlap): rows shared with the reference policy."""
    ref = candidates.where(F.col("policy") == reference).select("src", "dst", F.lit(1).alias("hit"))
    return candidates.join(ref, ["src", "dst"], "left").groupBy("policy", "src").agg(F.count("hit").alias("overlap"))


@dataclass(frozen=True)
class Gates:
    """Thresholds of the router."""

    low_margin: float = 0.015
    high_margin: float = 0.045
    low_support: int = 1
    high_support: int = 3
    suspicious_size: int = 95
    extreme_size: int = 140
    least_same: int = 3
    strong_same: int = 6
    least_overlap: int = 5
    strong_overlap: int = 7
    low_entropy: float = 0.55
    high_entropy: float = 0.85
    short: float = 2.0
    soup_margin: float = 0.02


def route(rows: DataFrame, policies: set[str], g: Gates = Gates()) -> DataFrame:
    """rows with `policy` and `reason`: an ordered list of decisions over margin, support, label_size, same_label, usable, entropy,
    duration, overlap_<policy>, consensus_soup and consensus_full. Unknown entropy and duration are null. policies are those on offer."""
    c = F.col
    suspicious = ~c("usable") | (c("margin") < g.low_margin) | (c("support") <= g.low_support) | (c("same_label") < g.least_same) | (c("label_size") > g.suspicious_size)
    extreme = (c("label_size") > g.extreme_size) | (c("support") == 0) | F.coalesce((c("duration") < g.short) & (c("margin") < g.high_margin), F.lit(False))
    strong = c("usable") & (c("margin") >= g.high_margin) & (c("support") >= g.high_support) & (c("same_label") >= g.strong_same) & (c("label_size") <= g.suspicious_size)
    steps: list[tuple[str, str, str, Column]] = [
        ("classaware", "classaware_c4", "low_entropy_classaware_agreement", F.coalesce(c("entropy") <= g.low_entropy, F.lit(False)) & (c("overlap_classaware") >= g.least_overlap) & ~extreme),
        ("classaware", "classaware_c4", "strong_graph_classaware_agreement", strong & F.coalesce(c("entropy") <= g.high_entropy, F.lit(True)) & (c("overlap_classaware") >= g.strong_overlap)),
        ("soup", "soup_c4", "soup_consensus_advantage", ~suspicious & (c("consensus_soup") - c("consensus_full") >= g.soup_margin)),
        ("exact", "exact", "extreme_low_graph_confidence_exact", suspicious & extreme),
        ("weak", "weak_c4", "weak_c4_low_graph_confidence", suspicious & (c("overlap_weak") >= g.least_overlap)),
        ("reciprocal", "reciprocal_only", "reciprocal_low_graph_confidence", suspicious),
        ("exact", "exact", "exact_low_graph_confidence", suspicious),
    ]
    policy, reason = F, F
    for key, name, why, test in steps:
        if key in policies:
            policy, reason = policy.when(test, name), reason.when(test, why)
    policy, reason = policy.when(strong, "full_c4").otherwise("classaware_c4"), reason.when(strong, "strong_graph_full_c4").otherwise("default_policy")
    return rows.withColumns({"policy": policy, "reason": reason})
