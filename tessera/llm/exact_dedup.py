"""Exact deduplication: two-pass Bloom filtering, DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, cut, hot_size


#: Bits of one bitmap of Spark's bitmap functions.
BLOCK = 32768


def normalised(text: Column) -> Column:
    """The text without any white space of SPACES; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def cells(key: Column, n_bits: int, n_hashes: int) -> list[Column]:
    """1-based cells of a key in a filter of n_bits. All lie in one block of 32,768 bits, so that one join finds them."""
    span = min(n_bits, BLOCK)
    block = F.pmod(F.xxhash64(key), F.lit(max(1, n_bits // BLOCK)))
    return [block * BLOCK + F.pmod(F.xxhash64(key, F.lit(i + 1)), F.lit(span)) + 1 for i in range(n_hashes)]


def repeated_filter(keys: DataFrame, key: str, n_bits: int, n_hashes: int = 2) -> DataFrame:
    """First pass: bitmaps (bucket, bits) of the cells that at least two rows hit, n_bits / 8 bytes in all.

    Cells are counted with map-side combination, so one key that holds most rows sends one row a task.
    """
    return (
        keys.select(F.explode(F.array_distinct(F.array(*cells(F.col(key), n_bits, n_hashes)))).alias("cell"))
        .groupBy("cell").agg(F.count("*").alias("n")).where("n >= 2")
        .groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
    )


def possibly_repeated(df: DataFrame, key: str, bitmaps: DataFrame, n_bits: int, n_hashes: int = 2) -> DataFrame:
    """Second pass: df with `maybe`, false only where no other row has the key. The bitmaps are broadcast; their size is bounded by n_bits."""
    kept, at = df.columns, cells(F.col(key), n_bits, n_hashes)
    side = F.broadcast(bitmaps.select(F.col("bucket").alias("_b"), F.col("bits").alias("_m")))
    df = df.join(side, F.bitmap_bucket_number(at[0]) == F.col("_b"), "left")
    return df.select(*kept, reduce(Column.__and__, [F.coalesce(bit(F.col("_m"), F.bitmap_bit_position(c)), F.lit(False)) for c in at]).alias("maybe"))


def bit(bits: Column, at: Column) -> Column:
    """Whether a bitmap's bit is set."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(1) == 1


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_bits: int = 1 << 30) -> DataFrame:
    """Mark which row of each set of equal texts stays.

    Texts are equal when identical after deleting spaces and U+0009..U+000D; a null text counts as empty. The row with
    the most code points in its original text stays, then the one with the smallest id. Every input column is kept
    (inside `row`, so that no name can clash), with keep_id, group_size, kept and text_sha256 beside it.
    Ids name documents: rows that repeat an id and a text share one decision. An empty table gives an empty result.

    The digests are written once; a first pass over them fills a Bloom filter with the cells that two rows hit, the
    second sends only rows whose cells are all set through the shuffle. All others pass straight through. So do the rows of
    hot groups, whose decisions are few enough to be broadcast: no group's texts come together in one task.
    The filter has bits_per_row bits for each row, never more than max_bits (128 MB); beyond that more rows shuffle,
    with the same result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).alias("id"), F.char_length(text).cast("long").alias("n"), F.sha2(normalised(F.col(text_col)), 256).alias("digest"))
    digests = cut(rows.select("id", "n", "digest"))
    n_bits = min(max_bits, max(1 << 15, bits_per_row * digests.count()))
    bitmaps = cut(repeated_filter(digests, "digest", n_bits))
    marked = possibly_repeated(rows, "digest", bitmaps, n_bits)
    groups = cut(
        possibly_repeated(digests, "digest", bitmaps, n_bits).where("maybe")
        .groupBy("digest").agg(F.min_by("id", F.struct(-F.col("n"), F.col("id").isNull(), "id")).alias("keep_id"), F.count("*").alias("group_size"))
    )
    least = hot_size(groups.agg(F.sum("group_size")).first()[0] or 0)
    hot = groups.where(F.col("group_size") > least).select(F.col("digest").alias("_d"), F.col("keep_id").alias("_k"), F.col("group_size").alias("_n"))
    marked = marked.join(F.broadcast(hot), F.col("digest") == F.col("_d"), "left")
    alone = F.col("_d").isNull()
    stay = marked.where("not maybe or _d is not null").select("row", "id", F.when(alone, F.col("id")).otherwise(F.col("_k")).alias("keep_id"), F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"), "digest")
    shuffled = marked.where("maybe and _d is null").select("row", "id", "digest").join(groups.where(F.col("group_size") <= least), "digest").select("row", "id", "keep_id", "group_size", "digest")
    return stay.unionByName(shuffled).select("row", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))
