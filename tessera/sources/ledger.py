"""Resume-safe work over conditions: results in partitions that a rerun replaces, and a ledger of those that are finished."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.lineage import cut
from tessera.sources.readers import optional_table


def finished(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger (keys..., rows) of the work at `path`; None before anything is finished."""
    return optional_table(spark, f"{path}/ledger.parquet")


def pending(plan: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """The distinct keys of the plan that the ledger does not name."""
    wanted = plan.select(*keys).distinct()
    done = finished(plan.sparkSession, path)
    return wanted if done is None else wanted.join(done.select(*keys), keys, "left_anti")


def run_pending(plan: DataFrame, path: str, keys: list[str], work: Callable[[DataFrame], DataFrame], steps: int = 4, most: int | None = None) -> int:
    """Does the plan's unfinished work and says how many steps it took; `work` maps rows of the plan to result rows that hold the keys.

    Pending keys are dealt to `steps` parts by a hash, whatever else is pending, and each part is one job: its results replace the
    partitions of its keys (and of no others), then its keys enter the ledger, those without results too. A run that ends between the two
    repeats that part, with the same outcome; what the ledger names is neither computed nor written again. `most` ends a run after
    so many parts. Keys must not be null.
    """
    spark, ran = plan.sparkSession, 0
    part = F.pmod(F.xxhash64(*keys), F.lit(steps))
    left = cut(pending(plan, path, keys).withColumn("_part", part))
    for (number,) in sorted(map(tuple, left.select("_part").distinct().collect())):  # `steps` numbers at most
        if most is not None and ran >= most:
            break
        own = left.where(F.col("_part") == number).drop("_part")
        rows = work(plan.join(own, keys, "left_semi"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{path}/results.parquet")
        counts = results(spark, path, rows.schema, keys).join(own, keys, "left_semi").groupBy(*keys).agg(F.count("*").alias("rows"))
        own.join(counts, keys, "left").select(*keys, F.coalesce("rows", F.lit(0)).cast("long").alias("rows")).write.mode("append").parquet(f"{path}/ledger.parquet")
        ran += 1
    return ran


def results(spark: SparkSession, path: str, schema=None, keys: list[str] | None = None) -> DataFrame:
    """All result rows written so far, read by their schema where it is known (keys of partitions may look like other types)."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{path}/results.parquet")


def finished_results(spark: SparkSession, path: str, schema, keys: list[str]) -> DataFrame:
    """Result rows of finished keys only: what a stopped run has left half-way is not among them."""
    done = finished(spark, path)
    rows = results(spark, path, schema, keys)
    return rows.limit(0) if done is None else rows.join(done.select(*keys), keys, "left_semi")
