"""Joins and counts of groups of which a few may hold very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.lineage import cut


def hot_size(total: int, most: int = 20_000) -> int:
    """The size beyond which a group of `total` rows is hot: fewer than `most` groups can be, whatever the input."""
    return max(32, -(-total // most))


def with_group(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined to groups(key, size, ...), one row for each key, where `size` counts the rows of a key and `total` all of them.

    Hot groups are few and broadcast, their rows stay where they are; the others, none of them large, meet in a shuffled join.
    """
    hot = groups.where(F.col(size) > hot_size(total))
    marked = rows.join(F.broadcast(hot.select(F.col(key).alias("_hot"))), F.col(key) == F.col("_hot"), "left")
    cold = marked.where("_hot is null").drop("_hot").join(groups.where(F.col(size) <= hot_size(total)), key)
    return cold.unionByName(rows.join(F.broadcast(hot), key))


def with_count(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with the number of rows that share its (non-null) key: counted with combination in the tasks, so that no key's rows meet in one."""
    counts = cut(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(name)))
    return with_group(df, counts, key, name, counts.agg(F.sum(name)).first()[0] or 0)


def within_blocks(rows: DataFrame, owner: str | None, key: str, block: int, most: int = 0) -> tuple[DataFrame, int]:
    """rows with `_own`, `_i` and `_j` (`_i` <= `_j`), and the number of partitions to deal them to: the rows of an owner (all rows where
    there is none) are dealt to blocks of about `block` by a hash of `key`, and each block stands beside each of its owner once.

    Rows of `_own` = `_i` meet those of `_own` = `_j`; equal keys share a block. Rows without an owner drop. Repartitioned by that
    number, no task has more than a few million pairs: the rows are few, their pairs are not, and sizes in bytes don't show it.

    A row is shuffled once for each block of its owner. With `most`, blocks of a large owner grow up to so many rows as long as there are
    more than 64 of them, so that this is at most 65 times up to 64 * most rows, and a task has up to most ** 2 pairs.
    """
    size = F.greatest(F.lit(block), F.least(F.lit(most), F.ceil(F.col("_n") / 64)))
    tasks = F.col("_n").cast("double") * F.col("_n") / F.pow(F.greatest(size, F.lit(1024)), F.lit(2.0))
    if owner is None:
        n = rows.count()
        sized, parts = rows.withColumn("_n", F.lit(n)), rows.sparkSession.range(1).select(F.lit(n).alias("_n")).select(tasks).first()[0]
    else:
        counts = cut(rows.where(F.col(owner).isNotNull()).groupBy(owner).agg(F.count("*").alias("_n")))
        total, parts = counts.agg(F.sum("_n"), F.sum(tasks)).first()
        sized, parts = with_group(rows, counts, owner, "_n", total or 0), parts or 0
    n = F.greatest(F.ceil(F.col("_n") / size), F.lit(1)).cast("int")
    own = sized.withColumn("_own", F.pmod(F.xxhash64(key), n).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), n - 1)))
    out = own.withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")}).drop("_n", "_other")
    return out, min(20_000, max(1, round(parts)))


def unordered(rows: DataFrame, owner: str | None, key: str, block: int, also: tuple[str, ...] = ()) -> DataFrame:
    """(owner, left, right) of the pairs of one owner's rows (of all rows without an owner), the smaller key first; columns `also` come
    twice, with _a and _b, in no order."""
    by = [owner] if owner else []
    dealt, parts = within_blocks(rows.where(F.col(key).isNotNull()).select(*by, key, *also), owner, key, block, 16_384)

    def side(place: str, end: str) -> DataFrame:
        own = dealt.where(F.col("_own") == F.col(place))
        return own.select(*by, "_i", "_j", F.col(key).alias(f"_k{end}"), *[F.col(c).alias(c + end) for c in also]).repartition(parts, *by, "_i", "_j")

    met = side("_i", "_a").join(side("_j", "_b"), [*by, "_i", "_j"]).where("_i <> _j or _k_a < _k_b")
    return met.select(*by, F.least("_k_a", "_k_b").alias("left"), F.greatest("_k_a", "_k_b").alias("right"), *[c + end for c in also for end in ("_a", "_b")])
