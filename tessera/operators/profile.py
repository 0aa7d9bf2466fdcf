"""Profiling of file tables: summaries, breakdowns, shares, outliers, coverage, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.lineage import cut


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with `name`, each row's number from 1 in the order of the whole table; the order names every row once.

    Rows are dealt by ranges of the order and counted by range, so that no task holds all of them. The dealt rows are
    checkpointed: both steps see the same ranges.
    """
    dealt = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    first = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(first), "_range").withColumn(name, (F.col("_before") + own).cast("long")).drop("_range", "_before")


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str], earlier: bool = False) -> DataFrame:
    """df with the sum of each column of `sums` (new name: column) over all rows up to and with a row, in the order of the whole table;
    `earlier` leaves the row itself out. The order names every row once.

    As in numbered, rows are dealt by ranges, and a range starts from the totals of those before it.
    """
    dealt = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    totals = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    first = totals.select("_range", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if earlier else 0)
    out = dealt.join(F.broadcast(first), "_range")
    out = out.withColumns({n: F.col(f"_b_{n}") + F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in sums.items()})
    return out.drop("_range", *[f"_b_{n}" for n in sums])


def speaker_stats(files: DataFrame, short: float = 2.0) -> DataFrame:
    """One row for each speaker: counts, durations (sample deviation), shares of short and of bad files, the commonest format."""
    c = F.col
    bad = (c("silence_ratio_40db") >= 0.5) | (c("clipping_frac") >= 0.01) | (c("rms_dbfs") <= -40.0)
    d = c("duration_s")
    return files.where(c("speaker_id").isNotNull()).groupBy("speaker_id").agg(
        F.count("*").alias("n_utts"), F.sum(d).alias("total_duration_s"), F.avg(d).alias("mean_duration_s"), F.stddev_samp(d).alias("std_duration_s"), F.min(d).alias("min_duration_s"), F.max(d).alias("max_duration_s"),
        F.avg((d < short).cast("int")).alias("short_utt_frac"), F.avg(bad.cast("int")).alias("bad_audio_frac"), F.mode("sample_rate_hz", True).alias("mode_sample_rate_hz"),
    )


def long_summary(df: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """(by, metric, count, mean, min, p10, p50, p90, p99, max): one unpivot, one aggregation, quantiles by ranges; `by` is not null."""
    from tessera.operators.quantiles import quantile_columns

    x = df.select(by, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([by], metrics, "metric", "value")
    v = F.col("value")
    whole = x.groupBy(by, "metric").agg(F.count(v).alias("count"), F.round(F.avg(v), 8).alias("mean"), F.round(F.min(v), 8).alias("min"), F.round(F.max(v), 8).alias("max"))
    names = {f"p{round(100 * q)}": ("value", q) for q in (0.1, 0.5, 0.9, 0.99)}
    ends = quantile_columns(x, names, (by, "metric")).select(by, "metric", *[F.round(n, 8).alias(n) for n in names])
    return whole.join(ends, [by, "metric"], "left").select(by, "metric", "count", "mean", "min", *names, "max")


def breakdown(df: DataFrame, buckets: list[str], aggregates: list[Column]) -> DataFrame:
    """Aggregates for each value of each bucket column, stacked with bucket_name: grouping sets, one pass over the input."""
    packed = df.withColumn("_b", F.explode(F.array(*[F.struct(F.lit(b).alias("bucket_name"), F.col(b).cast("string").alias("bucket_value")) for b in buckets])))
    return packed.groupBy("_b.bucket_name", "_b.bucket_value").agg(*aggregates)


def shares(df: DataFrame, *by: str) -> DataFrame:
    n = df.groupBy(*by).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def post_stratified(local: DataFrame, public: DataFrame, bucket: str, value: str) -> DataFrame:
    """One row: the sum over shared buckets of the local mean times the public share; missing buckets drop, weights stay."""
    means = local.groupBy(bucket).agg(F.avg(value).alias("m"))
    return means.join(shares(public, bucket), bucket).agg(F.sum(F.col("m") * F.col("share")).alias("estimate"))


def coverage(stats: DataFrame, key: str, metric: str) -> DataFrame:
    """(rank, key, metric, cumulative_fraction), the largest first; null fractions where the total is not positive."""
    x = running_sums(stats.select(key, metric, F.lit(1).cast("long").alias("_one")), [F.desc(metric), F.asc(key)], {"rank": "_one", "_so_far": metric})
    x = x.join(F.broadcast(stats.agg(F.sum(metric).alias("_total"))))
    return x.select("rank", key, metric, F.when(F.col("_total") > 0, F.col("_so_far") / F.col("_total")).alias("cumulative_fraction"))


def outliers(files: DataFrame, rules: list[tuple[str, str, bool]], most: int = 50, key: str = "filepath") -> DataFrame:
    """(key, outlier_rule, value): for each rule (name, column, descending) the first `most` rows, in one pass.

    Each task keeps its own best rows before the shuffle, since the rank is bounded.
    """
    e = F.array(*[F.struct(F.lit(n).alias("outlier_rule"), F.col(c).cast("double").alias("value"), (F.col(c) * (-1 if down else 1)).cast("double").alias("o")) for n, c, down in rules])
    x = files.select(key, F.inline(e)).where("value is not null")
    w = Window.partitionBy("outlier_rule").orderBy("o", key)
    return x.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).select(key, "outlier_rule", "value").distinct()


def head_of(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def audit_queue(files: DataFrame, rules: list[tuple[str, str, bool]], each: int = 5, most: int = 300) -> DataFrame:
    """Files to listen to: the first of each split and domain, then outliers; each file once, the first reason winning."""
    a = head_of(files, ["split", "domain_cluster"], [F.asc("row_index")], each).select("filepath", "row_index", F.lit("domain_stratified").alias("audit_reason"), F.lit(0).alias("p"))
    b = outliers(files, rules).select("filepath").distinct().join(files.select("filepath", "row_index"), "filepath").select("filepath", "row_index", F.lit("outlier").alias("audit_reason"), F.lit(1).alias("p"))
    one = head_of(a.unionByName(b), ["filepath"], [F.asc("p")], 1)
    return one.orderBy("p", "row_index").limit(most).select("filepath", "audit_reason")


def nearest_rank(df: DataFrame, column: str, q: float, by: str) -> DataFrame:
    """(by, value) at position round((n - 1) * q), half to even; no interpolation."""
    w = Window.partitionBy(by)
    x = df.where(F.col(column).isNotNull()).select(by, F.col(column).alias("value"), (F.row_number().over(w.orderBy(column)) - 1).alias("at"), F.count("*").over(w).alias("n"))
    return x.where(F.col("at") == F.bround((F.col("n") - 1) * F.lit(q), 0)).select(by, "value")


def latency_histogram(df: DataFrame, by: list[str], column: str, bounds: list[float]) -> DataFrame:
    """Counts at most each bound, cumulative, with count and sum."""
    return df.groupBy(*by).agg(F.count(column).alias("n"), F.sum(column).alias("total"), *[F.count_if(F.col(column) <= b).alias(f"le_{str(b).replace('.', '_')}") for b in bounds])


def missing_aware(df: DataFrame, column: str) -> DataFrame:
    v = F.coalesce(F.nullif(F.trim(column), F.lit("")), F.lit("(missing)"))
    return df.groupBy(v.alias("value")).agg(F.count("*").alias("n"))
