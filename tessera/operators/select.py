"""Selection of pseudo labels: composites of graph, margin and class steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.operators.profile import numbered
from tessera.operators.quantiles import quantile_columns, quantiles
from tessera.operators.skew import with_count, with_group
from tessera.sources.lineage import cut


def by_size(labels: DataFrame, least: int, most: int) -> DataFrame:
    """(id, label, size, pseudo): rows of clusters whose size lies between the bounds, with a dense pseudo label."""
    s = with_count(labels, "label", "size").where(F.col("size").between(least, most))
    names = numbered(s.select("label").distinct(), [F.asc("label")], "_n")
    return s.join(names, "label").select("id", "label", "size", (F.col("_n") - 1).alias("pseudo"))


def same_label_count(knn: DataFrame, labels: DataFrame, top: int) -> DataFrame:
    """(src, same): neighbours among the first `top` with the row's own label."""
    a = labels.select(F.col("id").alias("src"), F.col("label").alias("own"))
    b = labels.select(F.col("id").alias("dst"), F.col("label").alias("their"))
    return knn.where(F.col("rank") <= top).join(a, "src").join(b, "dst").groupBy("src").agg(F.count_if(F.col("own") == F.col("their")).alias("same"))


def strict_consensus(labels: DataFrame, main: DataFrame, others: list[DataFrame], sizes: tuple[int, int], least_margin: float, margin_quantile: float, top: int, least_same: int, least_models: int, least_rows: int, least_share: float) -> DataFrame:
    """(id, label, margin, confirmed, kept): rows of well-sized clusters with a wide margin that enough models confirm, kept where
    enough of their cluster is selected."""
    s = with_count(labels, "label", "size")
    m = graph.margins(main, 1, top)
    bound = quantiles(m, "margin", [margin_quantile]).select(F.greatest(F.col("value"), F.lit(least_margin)).alias("bound"))
    m = m.join(F.broadcast(bound))
    votes = None
    for knn in others:
        v = same_label_count(knn, labels, top).select("src", (F.col("same") >= least_same).cast("int").alias("yes"))
        votes = v if votes is None else votes.unionByName(v)
    confirmed = votes.groupBy("src").agg(F.sum("yes").alias("confirmed"))
    x = s.join(m, F.col("id") == F.col("src")).drop("src").join(confirmed, F.col("id") == F.col("src"), "left")
    ok = F.col("size").between(*sizes) & (F.col("margin") >= F.col("bound")) & (F.coalesce("confirmed", F.lit(0)) >= least_models)
    x = cut(x.withColumn("ok", F.coalesce(ok, F.lit(False))))
    counts = x.groupBy("label").agg(F.count("*").alias("_rows"), F.count_if("ok").alias("n_ok"))
    x = with_group(x, cut(counts), "label", "_rows", x.count())
    kept = F.col("ok") & (F.col("n_ok") >= least_rows) & (F.col("n_ok") / F.col("size") >= least_share)
    return x.select("id", "label", F.round("margin", 9).alias("margin"), F.coalesce("confirmed", F.lit(0)).cast("long").alias("confirmed"), kept.alias("kept"))


def weighted(labels: DataFrame, knn: DataFrame, sizes: tuple[int, int], top: int, least: float) -> DataFrame:
    """(id, confidence, weight) of rows of well-sized clusters: margin between its 5th and 95th percentile, same-label share, reciprocal
    share; the weight grows from one half at the least confidence to one."""
    s = with_count(labels, "label", "size").where(F.col("size").between(*sizes))
    m = graph.margins(knn, 1, top)
    q = quantile_columns(m, {"lo": ("margin", 0.05), "hi": ("margin", 0.95)})
    m = m.join(F.broadcast(q)).select(F.col("src").alias("id"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("margin") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6)))).alias("m"))
    g = same_label_count(knn, labels, top).select(F.col("src").alias("id"), (F.col("same") / top).alias("g"))
    r = graph.mutual(knn, top, top).groupBy(F.col("src").alias("id")).agg((F.count("*") / top).alias("r"))
    x = s.join(m, "id").join(g, "id").join(r, "id", "left").withColumn("confidence", (0.4 * F.col("m") + 0.3 * F.col("g") + 0.2 * F.coalesce("r", F.lit(0.0))) / 0.9)
    x = x.where(F.col("confidence") >= least)
    return x.select("id", F.round("confidence", 8).alias("confidence"), F.round(0.5 + 0.5 * (F.col("confidence") - least) / (1 - least), 8).alias("weight"))


def soft_labels(fused: DataFrame, labels: DataFrame, top: int, temperature: float = 0.1) -> DataFrame:
    """(src, label, prob, place): softmax of the fused score of each neighbouring cluster, the best `top`."""
    b = labels.select(F.col("id").alias("dst"), "label")
    s = fused.join(b, "dst").groupBy("src", "label").agg(F.sum("score").alias("s"))
    w = Window.partitionBy("src")
    s = s.withColumn("place", F.row_number().over(w.orderBy(F.desc(F.round("s", 12)), "label"))).where(F.col("place") <= top)
    e = F.exp((F.col("s") - F.max("s").over(w)) / temperature)
    return s.withColumn("e", e).select("src", "label", (F.col("e") / F.sum("e").over(w)).alias("prob"), "place")


def kept_soft_labels(soft: DataFrame, labels: DataFrame, confidence: DataFrame, sizes: tuple[int, int], least: float) -> DataFrame:
    """(src, label, prob, place, confidence) of the soft labels whose clusters have a size between the bounds, renormalised over these.

    soft(src, label, prob, place) and labels(id, label) speak of the same clusters. Rows stay whose own cluster is kept and whose
    confidence(src, confidence) is at least `least`; a row without a kept cluster among its soft labels drops.
    """
    kept = with_count(labels, "label", "_size").where(F.col("_size").between(*sizes))
    rows = kept.select(F.col("id").alias("src")).join(confidence.where(F.col("confidence") >= least), "src")
    s = soft.join(kept.select("label").distinct(), "label", "left_semi").join(rows, "src")
    w = Window.partitionBy("src")
    return s.select("src", "label", (F.col("prob") / F.sum("prob").over(w)).alias("prob"), F.row_number().over(w.orderBy("place")).cast("long").alias("place"), "confidence")


def cohort(rows: DataFrame, owner: str, key: str, least: int, most: int, total: int) -> DataFrame:
    """Rows of a cohort bank: at least and at most so many of an owner, and `total` in all, owners in turn."""
    from tessera.operators.sampling import capped, round_robin

    return round_robin(capped(rows, owner, [F.asc(key)], least, most), owner, [F.asc(key)], total)


def stable_groups(first: DataFrame, second: DataFrame) -> DataFrame:
    """(id, label): of each cluster of `second`, its largest part that shares one cluster of `first`; the smaller label wins a tie."""
    x = second.select("id", F.col("label").alias("b")).join(first.select("id", F.col("label").alias("a")), "id")
    n = x.groupBy("b", "a").agg(F.count("*").alias("n"))
    best = n.groupBy("b").agg(F.min_by("a", F.struct(-F.col("n"), "a")).alias("a"))
    return x.join(best, ["b", "a"]).select("id", F.col("b").alias("label"))
