"""Exact quantiles of whole columns and large groups, from counts of ranges: no task holds a column's distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.lineage import cut


def quantiles(df: DataFrame, column: str | Column, at: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, q, value): the exact quantiles `at` of a column in each group, interpolated linearly; nulls and NaN do not count.

    Equal values are counted first (combined in the tasks) and dealt by ranges of (group, value); the ranges' counts, a row for each
    range and group, tell which ranges hold a wanted place, and only these are ordered. Groups of any size, and one group for all
    rows, so spread over the ranges. A group without values has no rows.
    """
    value = F.col(column) if isinstance(column, str) else column
    rows = df.select(*by, value.cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    counts = rows.groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    dealt = cut(counts.repartitionByRange(*by, "_v").withColumn("_range", F.spark_partition_id()))
    group = Window.partitionBy(*by)
    ranges = dealt.groupBy(*by, "_range").agg(F.sum("_n").alias("_in"))
    ranges = ranges.withColumns({"_before": F.coalesce(F.sum("_in").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_in").over(group)})
    wanted = ranges.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in at]))).withColumn("_at", F.col("q") * (F.col("_all") - 1))
    wanted = wanted.withColumn("_place", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at"))))).where("_place >= _before and _place < _before + _in")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"w.{c}")) for c in (*by, "_range")]
    held = wanted.groupBy(*by, "_range").agg(F.first("_before").alias("_before"), F.collect_set(F.struct("q", "_at", "_place")).alias("_wanted"))
    on = same[0]
    for c in same[1:]:
        on = on & c
    running = F.sum("d._n").over(Window.partitionBy(*[f"d.{c}" for c in (*by, "_range")]).orderBy("d._v").rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt.alias("d").join(held.alias("w"), on).select(*[F.col(f"d.{c}").alias(c) for c in by], F.col("d._v").alias("_v"), F.col("d._n").alias("_n"), (F.col("w._before") + running).alias("_end"), "w._wanted")
    found = placed.select(*by, "_v", "_n", "_end", F.inline("_wanted")).where("_place >= _end - _n and _place < _end")
    low, high = F.max(F.when(F.col("_place") == F.floor("_at"), F.col("_v"))), F.max(F.when(F.col("_place") == F.ceil("_at"), F.col("_v")))
    return found.groupBy(*by, "q", "_at").agg(low.alias("_lo"), high.alias("_hi")).select(*by, "q", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_at") - F.floor("_at"))).alias("value"))


def quantile_columns(df: DataFrame, columns: dict[str, tuple[str, float]], by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each group (one in all without `by`): new name -> (column, q). Columns are stacked, so that one pass answers all."""
    names = sorted({c for c, _ in columns.values()})
    stacked = df.select(*by, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(list(by), names, "_column", "_value")
    found = quantiles(stacked, "_value", sorted({q for _, q in columns.values()}), (*by, "_column"))
    picked = [F.max(F.when((F.col("_column") == c) & (F.col("q") == F.lit(float(q))), F.col("value"))).alias(n) for n, (c, q) in columns.items()]
    return found.groupBy(*by).agg(*picked) if by else found.agg(*picked)
