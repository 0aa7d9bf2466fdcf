"""Importance resampling towards a target text: array-scored weights, exact k-th key by radix selection, ranks for the drawn rows only."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as k
from tessera.llm.common import cut, small_batches
from tessera.operators.profile import numbered

PIECE = 1 << 18
#: A word of more bytes than this is hashed by itself.
LONG = 64
#: The reflected polynomial of crc32.
POLYNOMIAL = 0xEDB88320
#: Bits of one digit of the selection: a pass returns at most 2**DIGIT counts.
DIGIT = 16
_tables: list[np.ndarray] = []


def byte_steps() -> np.ndarray:
    """What crc32's register becomes after one more byte, for each value of its low byte."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), x >> np.uint32(1))
    return x


def zero_steps() -> np.ndarray:
    """[bit, byte, value]: what a register of one non-zero byte becomes after 2**bit zero bytes; made once in each worker."""
    if not _tables:
        step = byte_steps()
        state = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
        now = step[state & 0xFF] ^ (state >> np.uint32(8))
        tables = [now]
        for _ in range(31):
            now = apply(tables[-1], tables[-1])
            tables.append(now)
        _tables.append(np.stack(tables))
    return _tables[0]


def apply(table: np.ndarray, state: np.ndarray) -> np.ndarray:
    return table[0][state & 0xFF] ^ table[1][(state >> np.uint32(8)) & 0xFF] ^ table[2][(state >> np.uint32(16)) & 0xFF] ^ table[3][state >> np.uint32(24)]


def advance(state: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Registers after n[i] zero bytes: the register is linear, so each bit of n is one table."""
    out = state.copy()
    for bit in range(int(n.max()).bit_length() if len(n) else 0):
        at = np.flatnonzero((n >> bit) & 1)
        out[at] = apply(zero_steps()[bit], out[at])
    return out


def registers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The crc32 register of each range of bytes, begun at zero: byte after byte over all ranges that still have one."""
    step, length = byte_steps(), end - start
    out = np.zeros(len(start), np.uint32)
    active = np.flatnonzero(length <= LONG)
    for at in range(LONG):
        active = active[length[active] > at]
        if not len(active):
            break
        now = out[active]
        out[active] = step[(now ^ data[start[active] + at]) & 0xFF] ^ (now >> np.uint32(8))
    for i in np.flatnonzero(length > LONG):
        ones = advance(np.array([0xFFFFFFFF], np.uint32), length[i : i + 1])[0]
        out[i] = np.uint32(zlib.crc32(data[start[i] : end[i]].tobytes()) ^ 0xFFFFFFFF) ^ ones
    return out


def buckets_of(texts: pa.Array, n_buckets: int, order: int = 3) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """For runs of whole texts: (first text, end, words of each text, bucket arrays, text numbers), an array for each number of words."""
    data, offsets = k.bytes_of(texts)
    step = byte_steps()
    for a, b in k.pieces(offsets, PIECE):
        own = k.lower_ascii(data[offsets[a] : offsets[b]])
        start, end, text = k.words(own, offsets[a : b + 1] - offsets[a], k.no_letter)
        word, length = registers(own, start, end), end - start
        state = advance(np.full(len(word), 0xFFFFFFFF, np.uint32), length) ^ word
        buckets, owners = [(~state % np.uint32(n_buckets)).astype(np.int64)], [text]
        for n in range(1, order):  # one more word after each run: a space, then the word's register joins by linearity
            state = state[:-1]
            state = step[(state ^ np.uint32(0x20)) & 0xFF] ^ (state >> np.uint32(8))
            state = advance(state, length[n:]) ^ word[n:]
            whole = text[: len(text) - n] == text[n:]
            buckets.append((~state % np.uint32(n_buckets)).astype(np.int64)[whole])
            owners.append(text[n:][whole])
        yield a, b, np.bincount(text, minlength=b - a), buckets, owners


def feature_counts(df: DataFrame, text_col: str, n_buckets: int) -> np.ndarray:
    """How many features of the whole table fall into each bucket: every task sends at most n_buckets sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for *_, buckets, _ in buckets_of(batch.column(0), n_buckets):
                for x in buckets:
                    total += np.bincount(x, minlength=n_buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    out = np.zeros(n_buckets, np.int64)
    for r in df.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # n_buckets rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain: the floor of 1000 times the logarithm of its smoothed share in the target over that in the corpus."""
    n, all_corpus, all_target = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (all_corpus + n) / ((float(s) + 1) * (all_target + n)))) for s, t in zip(corpus, target, strict=True)], np.int64)


def noise(id_col: Column, seed: int) -> Column:
    """A Gumbel draw in thousandths, fixed by seed and id; a null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighed(df: DataFrame, gain: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, n_features, weight) of every row: sums of the broadcast gains (8 bytes a bucket) over arrays of buckets."""
    shared = df.sparkSession.sparkContext.broadcast(gain)

    @F.arrow_udf("n_words long, n_features long, weight long")
    def weigh(text: pa.Array) -> pa.Array:
        words, features, weight = (np.zeros(len(text), np.int64) for _ in range(3))
        for a, b, n, buckets, owners in buckets_of(text, len(shared.value)):
            words[a:b] = n
            for x, owner in zip(buckets, owners, strict=True):
                features[a:b] += np.bincount(owner, minlength=b - a)
                ends = np.concatenate([[0], np.cumsum(shared.value[x])])
                at = np.searchsorted(owner, np.arange(b - a + 1))
                weight[a:b] += ends[at[1:]] - ends[at[:-1]]
        return pa.StructArray.from_arrays([pa.array(words), pa.array(features), pa.array(weight)], names=["n_words", "n_features", "weight"])

    out = df.select(F.col(id_col).cast("long").alias("id"), weigh(F.col(text_col)).alias("w"))
    return out.select("id", "w.n_words", "w.n_features", "w.weight")


def digits(parts: list[tuple[Column, int, int]]) -> list[Column]:
    """Digits of a composite key, the highest first: each part (column, least, greatest value) from its least value on, in as many digits as its range needs."""
    out = []
    for column, low, high in parts:
        width = max(1, (high - low).bit_length())
        for at in reversed(range(0, width, DIGIT)):
            out.append(F.shiftright(column - F.lit(low), at).bitwiseAND((1 << DIGIT) - 1))
    return out


def select_first(rows: DataFrame, parts: list[tuple[str, bool]], n: int) -> Column:
    """Which of `rows` are the n with the smallest composite key, a condition over its integer columns; parts are (column, descending).

    Radix selection: each pass counts, among the rows that share the digits found so far, how many have each value of the next digit,
    and so finds the digit of the n-th key. Passes end when the digits found divide the rows exactly. A pass returns at most
    2**DIGIT counts, combined in the tasks, so neither ties nor one value that most rows share brings rows together.
    """
    if n <= 0:
        return F.lit(False)
    columns = [-F.col(c) if down else F.col(c) for c, down in parts]
    bounds = rows.agg(*[f(c).alias(f"_{i}_{j}") for i, c in enumerate(columns) for j, f in enumerate((F.min, F.max))], F.count("*").alias("n")).first()
    if bounds["n"] <= n:
        return F.lit(True)
    key = digits([(c, bounds[f"_{i}_0"], bounds[f"_{i}_1"]) for i, c in enumerate(columns)])
    chosen, prefix, wanted = F.lit(False), F.lit(True), n
    for digit in key:
        counts = sorted((r["d"], r["n"]) for r in rows.where(prefix).groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect())
        before = 0
        for value, size in counts:
            if before + size >= wanted:
                break
            before += size
        chosen = chosen | (prefix & (digit < value))
        prefix = prefix & (digit == value)
        wanted -= before
        if size == wanted:
            break
    return chosen | prefix


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", share: tuple[int, int] = (5, 100), least_words: int = 20, n_buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row of df: which rows to draw so that they look like the target's texts.

    Texts are lower-cased (A-Z) and cut into words of letters, digits and characters beyond ASCII; features are runs of one to three
    words, hashed by crc32 into n_buckets. A row's weight is the sum of its features' gains; its score adds Gumbel noise fixed by the
    seed and id. Of the rows with at least least_words words, floor(share * their number) with the highest scores are drawn (on
    ties smaller ids first, null ids last) and ranked from 1; all others have a null rank.

    Ids are integers. Rows that repeat an id have equal noise and stand by themselves; equal rows are drawn in the order of the written
    scores. Null texts have no words; an empty table gives an empty result; columns other than id_col and text_col are not read.
    An empty target has gains by the corpus alone. Scores are written once, without texts; the k-th score is found by radix
    selection over them, and only drawn rows are sorted.
    """
    small_batches(df.sparkSession)
    gain = gains(feature_counts(df, text_col, n_buckets), feature_counts(target, target_text, n_buckets))
    scored = weighed(df, gain, id_col, text_col).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    scored = cut(scored).withColumn("_place", F.monotonically_increasing_id()).withColumns({"_missing": F.col("id").isNull().cast("int"), "_id": F.coalesce("id", F.lit(0))})
    able = F.col("n_words") >= least_words
    n = scored.where(able).count() * share[0] // share[1]
    drawn = able & select_first(scored.where(able), [("score", True), ("_missing", False), ("_id", False), ("_place", False)], n)
    ranked = numbered(scored.where(drawn), [F.desc("score"), F.asc("_missing"), F.asc("_id"), F.asc("_place")], "rank")
    out = scored.where(~drawn).withColumn("rank", F.lit(None).cast("long")).unionByName(ranked)
    return out.select("id", "n_words", "n_features", "weight", "score", "rank")


def drawn_rows(df: DataFrame, resampled: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The drawn rows of df, each inside `row` (no name can clash), with score and rank; ids name rows."""
    first = resampled.where("rank is not null").select(F.col("id").alias("_id"), "score", "rank")
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).cast("long").alias("_key"))
    return packed.join(first, F.col("_key").eqNullSafe(F.col("_id"))).select("row", "score", "rank")
