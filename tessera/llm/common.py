"""Helpers shared by the text operators: packing rows, bounded samples, checkpoints."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.lineage import cut, fresh_path

__all__ = ["cut"]

#: Characters that separate words: space and U+0009..U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def table(df: DataFrame) -> DataFrame:
    """df, written as Parquet in the shared checkpoint folder and read again: for results that hold texts."""
    path = fresh_path(df.sparkSession, ".parquet")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Arrow batches of at most `rows` rows from here on in the session; a smaller setting stays.

    A batch holds whole texts, in the JVM and in the Python worker; Spark's 10,000 rows fill an executor of 3 GB.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % modulus


def bounded_sample(df: DataFrame, key: Column, bound: int, by: str | None = None, least: int = 32, broadcast_rows: int = 100_000) -> DataFrame:
    """Rows chosen by a hash of key, about `bound` in all (of each value of `by` an equal share of it, but about `least` rows at the least).

    Counts first (only the columns needed), then keeps rows whose 63-bit hash lies below the share bound/count. Up to broadcast_rows
    values of `by`, their shares are broadcast and no row is shuffled. A value of `by` has all its rows where it has few; nulls have none.
    """
    unit = F.xxhash64(key, F.lit("sample")).bitwiseAND((1 << 63) - 1)
    if by is None:
        return df.where(unit <= highest_hash(bound, df.count()))
    counts = cut(df.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n")))
    values = counts.count()
    share = float(max(least, bound / max(1, values)))
    rate = F.when(F.col("_n") <= share, F.lit((1 << 63) - 1)).otherwise(F.greatest(F.lit(1), F.floor(share / F.col("_n") * float(1 << 62)) * 2))
    rates = counts.select("_by", rate.cast("long").alias("_rate"))
    return df.join(F.broadcast(rates) if values <= broadcast_rows else rates, F.col(by) == F.col("_by")).where(unit <= F.col("_rate")).drop("_by", "_rate")


def highest_hash(bound: float, n: int) -> int:
    """The 63-bit hash up to which about `bound` of n rows lie: never so low that none can, however many rows there are."""
    return (1 << 63) - 1 if n <= bound else max(1, int((1 << 63) * Fraction(bound) / n) - 1)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, bound: int) -> DataFrame:
    """(key, label, text) of about `bound` labelled documents; labels other than 0 and 1 are left out, a null text counts as empty.

    The labels are sampled by a hash of the id first. Their number is bounded, so they are broadcast and no text is shuffled.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and _id is not null")
    chosen = bounded_sample(known, F.col("_id"), bound)
    return docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id").select(F.col("_id").alias("key"), "label", "text")


def hot_size(total: int, most: int = 20_000) -> int:
    """The size beyond which a group of `total` rows is hot: fewer than `most` groups can be, whatever the input."""
    return max(32, -(-total // most))


def with_group(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined to groups(key, size, ...), one row for each key, where `size` counts the rows of a key and `total` all of them.

    Hot keys (see hot_size) are broadcast, and their rows stay where they are. The others, none of which holds more than a small
    part of the rows, meet in a shuffled join. So no key's rows come together in one task.
    """
    hot = groups.where(F.col(size) > hot_size(total))
    marked = rows.join(F.broadcast(hot.select(F.col(key).alias("_hot"))), F.col(key) == F.col("_hot"), "left")
    few = marked.where(F.col("_hot").isNull()).drop("_hot").join(groups.where(F.col(size) <= hot_size(total)), key)
    return few.unionByName(rows.join(F.broadcast(hot), key))
