"""MinHash near-dedup: banded candidates, sequential Bayesian verification of signatures, exact verification of survivors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as k
from tessera.llm.common import cut, small_batches, with_group
from tessera.llm.exact_dedup import cells, possibly_repeated
from tessera.operators.components import components

PIECE = 1 << 17


@dataclass(frozen=True)
class Near:
    """words: of a shingle. percent: least similarity of a link. bands x rows hashes make a signature. batch: hashes compared at a time.

    A pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8**4)**32 > 0.9999999. miss: a pair is pruned when the
    posterior probability of reaching the similarity falls below it. block: most members of a bucket compared in one group.
    """

    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    batch: int = 16
    miss: float = 1e-6
    block: int = 512

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def coefficients(self) -> tuple[np.ndarray, np.ndarray]:
        made = np.random.default_rng(20240229).integers(1, 1 << 63, size=(2, self.hashes), dtype=np.uint64)
        return made[0] | np.uint64(1), made[1]

    def least_matches(self) -> np.ndarray:
        """For each count of compared hashes, the fewest matches with which a pair stays.

        With a uniform prior the similarity's posterior after m matches of n is Beta(m + 1, n - m + 1); the probability
        that it reaches t is that of at most m successes in n + 1 trials of chance t.
        """
        t, out = self.percent / 100, []
        for n in range(self.batch, self.hashes + 1, self.batch):
            below = np.cumsum([comb(n + 1, i) * t**i * (1 - t) ** (n + 1 - i) for i in range(n + 1)])
            out.append(int(np.searchsorted(below, self.miss, side="left")))
        return np.array(out)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of `size` words and their text number; a text with fewer words has one, its whole sequence."""
    start, end, text = k.words(data, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = k.mix(k.Prefix(k.lower_ascii(data)).range(start, end))
    n = np.bincount(text, minlength=len(offsets) - 1)
    out, owner = [], []
    for length in range(1, size + 1):
        if len(word) < length:
            break
        h = np.full(len(word) - length + 1, length, np.uint64)
        for i in range(length):
            h = k.mix(h * k.BASE + word[i : len(word) - length + 1 + i])
        same = text[: len(h)] == text[length - 1 :]
        if length < size:
            same &= n[text[: len(h)]] == length
        out.append(h[same])
        owner.append(text[: len(h)][same])
    h, owner = np.concatenate(out), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return h[order], owner[order]


def sets_of(texts: pd.Series, p: Near) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, one text after the other, and their n + 1 offsets."""
    data, offsets = k.bytes_of(pa.array(texts, pa.string()))
    own = []
    for a, b in k.pieces(offsets, PIECE):
        h, owner = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], p.words)
        at = np.searchsorted(owner, np.arange(b - a + 1))
        own += [np.unique(h[at[i] : at[i + 1]]) for i in range(b - a)]
    return np.concatenate([np.zeros(0, np.uint64), *own]), np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)


def signatures(docs: DataFrame, p: Near) -> DataFrame:
    """(id, text) to (id, n_shingles, set_a, set_b, sig): the set's size, 128 bits that name it, and its MinHash signature."""
    times, plus = p.coefficients()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k.turn_to("minhash")
        for batch in batches:
            data, offsets = k.bytes_of(k.column(batch, "text"))
            ids = k.column(batch, "id")
            for a, b in k.pieces(offsets, PIECE):
                h, owner = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], p.words)
                at = np.searchsorted(owner, np.arange(b - a + 1))
                n, set_a, set_b, sig = [], [], [], []
                for i in range(b - a):
                    own = np.unique(h[at[i] : at[i + 1]])
                    n.append(len(own))
                    set_a.append(int(k.mix(own).sum(dtype=np.uint64).view(np.int64)))
                    set_b.append(int(np.bitwise_xor.reduce(k.mix(own * k.BASE)).view(np.int64)) if len(own) else 0)
                    low = np.full(p.hashes, np.iinfo(np.uint64).max)
                    for j in range(0, len(own), 1024):
                        np.minimum(low, (times[:, None] * own[None, j : j + 1024] + plus[:, None]).min(axis=1), out=low)
                    sig.append((low >> np.uint64(32)).astype(np.uint32).tobytes() if len(own) else None)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(set_a, pa.int64()), pa.array(set_b, pa.int64()), pa.array(sig, pa.binary())], names=["id", "n_shingles", "set_a", "set_b", "sig"])
            del batch, data, ids
            k.rest()

    return docs.mapInArrow(sign, "id long, n_shingles long, set_a long, set_b long, sig binary")


def unpacked(sigs: list[bytes], p: Near) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint32).reshape(-1, p.hashes)


def band_keys(sig: np.ndarray, p: Near) -> np.ndarray:
    """One 64-bit key for each row and band."""
    h = np.broadcast_to(np.arange(1, p.bands + 1, dtype=np.uint64), (len(sig), p.bands)).copy()
    parts = sig.reshape(-1, p.bands, p.rows).astype(np.uint64)
    for i in range(p.rows):
        h = k.mix(h * k.BASE + parts[:, :, i])
    return h


def buckets(signed: DataFrame, p: Near) -> DataFrame:
    """(bucket, id): each document in one bucket for each band."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(unpacked(k.column(batch, "sig").to_pylist(), p), p)
                ids = np.repeat(k.column(batch, "id").to_numpy(), p.bands)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], names=["bucket", "id"])

    return signed.select("id", "sig").mapInArrow(deal, "bucket long, id long")


def alive(x: np.ndarray, y: np.ndarray, p: Near, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the two signature arrays that no batch prunes, and their matches. Later batches are compared for these only."""
    keep, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
    for i, most in enumerate(least):
        cut_at = slice(i * p.batch, (i + 1) * p.batch)
        matches[keep] += (x[keep, cut_at] == y[keep, cut_at]).sum(axis=1)
        keep = keep[matches[keep] >= most]
    return keep, matches[keep]


def plausible(pairs: DataFrame, signed: DataFrame, p: Near) -> DataFrame:
    """Sequential Bayesian verification of pairs (a, b): those whose sizes and signatures leave the similarity possible."""
    least = p.least_matches()
    side = lambda x: signed.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= p.percent * F.greatest("n_a", "n_b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep, _ = alive(unpacked(k.column(batch, "sig_a").to_pylist(), p), unpacked(k.column(batch, "sig_b").to_pylist(), p), p, least)
                yield pa.RecordBatch.from_arrays([k.column(batch, "a").take(pa.array(keep)), k.column(batch, "b").take(pa.array(keep))], names=["a", "b"])

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(check, "a long, b long")


def texts_of(docs: DataFrame, ids: DataFrame, max_bits: int) -> DataFrame:
    """docs(id, text) of ids(id). A bitmap of the ids (at most max_bits) keeps other texts out of the shuffle that follows."""
    n_bits = min(max_bits, max(1 << 15, 32 * ids.count()))
    marks = ids.select(F.explode(F.array(*cells(F.col("id"), n_bits, 2))).alias("cell")).distinct()
    bitmaps = marks.groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
    return possibly_repeated(docs, "id", cut(bitmaps), n_bits).where("maybe").select("id", "text")


def verified(pairs: DataFrame, docs: DataFrame, p: Near, max_bits: int = 1 << 30) -> DataFrame:
    """Pairs (a, b) whose full shingle sets reach the similarity.

    The partners of an a are dealt to groups of about 64, each with one copy of a's text.
    """
    pairs = cut(pairs)
    size = pairs.groupBy("a").agg(F.ceil(F.count("*") / 64).alias("parts"))
    dealt = pairs.join(size, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b")
    needs = dealt.select("a", "part", F.col("b").alias("id")).unionByName(dealt.select("a", "part", F.col("a").alias("id")).distinct())
    texts = texts_of(docs, pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), max_bits)

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        h, at = sets_of(group["text"], p)
        sets = [h[at[i] : at[i + 1]] for i in range(len(group))]
        hub = sets[int(np.flatnonzero(group["id"] == key[0])[0])]
        common = [len(np.intersect1d(hub, s, assume_unique=True)) for s in sets]
        near = [100 * c >= p.percent * (len(hub) + len(s) - c) for c, s in zip(common, sets, strict=True)]
        out = group.loc[near & (group["id"] != key[0]).to_numpy(), ["id"]].rename(columns={"id": "b"})
        return out.assign(a=key[0])[["a", "b"]]

    return needs.join(texts, "id").groupBy("a", "part").applyInPandas(compare, "a long, b long")


def unsettled(members: DataFrame, signed: DataFrame, docs: DataFrame, p: Near, max_bits: int = 1 << 30) -> DataFrame:
    """Links (a, b) between different components of one bucket, other than those of its hub's component among themselves.

    members(bucket, id, component_id, hub_component). Members outside the hub's component (free ones) meet all others of the
    bucket, in blocks of free ones by blocks of all. First come the signatures: who has no partner that the posterior leaves
    possible goes. The others meet once more in their block with their texts, and their full sets are compared. Of a member's
    links into one component the first is returned, so neither step's result is larger than its input.
    """
    least = p.least_matches()
    rows = members.withColumn("free", F.col("component_id") != F.col("hub_component"))
    mixed = cut(rows.groupBy("bucket").agg(F.count_if("free").alias("n_free"), F.count("*").alias("n")).where("n_free > 0"))
    rows = with_group(rows, mixed, "bucket", "n", mixed.agg(F.sum("n")).first()[0] or 0).join(signed.select("id", "n_shingles", "sig"), "id")
    across = lambda n: F.ceil(F.col(n) / p.block)
    dealt = lambda n: F.pmod(F.xxhash64("id"), across(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), across(n) - 1))
    asks = rows.where("free").withColumn("ask", dealt("n_free")).withColumn("tell", every("n")).withColumn("asks", F.lit(True))
    tells = rows.withColumn("tell", dealt("n")).withColumn("ask", every("n_free")).withColumn("asks", F.lit(False))
    block, take = ["bucket", "ask", "tell"], ["bucket", "ask", "tell", "asks", "id", "component_id", "free"]

    def sides(group: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        return group[group["asks"]], group[~group["asks"]]

    def others(x: pd.DataFrame, y: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
        """For each asking row the rows of y in other components; of two free rows, one asks."""
        y_id, y_part, y_free = y["id"].to_numpy(), y["component_id"].to_numpy(), y["free"].to_numpy()
        for i, (own, part) in enumerate(zip(x["id"], x["component_id"], strict=True)):
            yield i, np.flatnonzero((y_part != part) & (~y_free | (y_id > own)))

    def prune(group: pd.DataFrame) -> pd.DataFrame:
        x, y = sides(group)
        keep_x, keep_y = np.zeros(len(x), bool), np.zeros(len(y), bool)
        if len(x) and len(y):
            sx, sy, nx, ny = unpacked(x["sig"].tolist(), p), unpacked(y["sig"].tolist(), p), x["n_shingles"].to_numpy(), y["n_shingles"].to_numpy()
            for i, rest in others(x, y):
                rest = rest[100 * np.minimum(ny[rest], nx[i]) >= p.percent * np.maximum(ny[rest], nx[i])]
                left, _ = alive(np.broadcast_to(sx[i], (len(rest), p.hashes)), sy[rest], p, least)
                keep_x[i] = len(left) > 0
                keep_y[rest[left]] = True
        k.rest()
        return pd.concat([x[keep_x], y[keep_y]])[take]

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        x, y = sides(group)
        a, b = [], []
        if len(x) and len(y):
            h, at = sets_of(group["text"], p)
            n, number = np.diff(at), np.unique(h, return_inverse=True)[1]
            rows_x, rows_y = np.flatnonzero(group["asks"]), np.flatnonzero(~group["asks"])
            flat = np.concatenate([number[at[j] : at[j + 1]] for j in rows_y])
            begin = np.concatenate([[0], np.cumsum(n[rows_y])[:-1]])
            held = np.zeros(int(number.max(initial=-1)) + 1, np.int64)
            y_id, y_part = y["id"].to_numpy(), y["component_id"].to_numpy()
            for i, rest in others(x, y):
                own = number[at[rows_x[i]] : at[rows_x[i] + 1]]
                held[own] = 1
                common = np.add.reduceat(held[flat], begin)
                held[own] = 0
                near = rest[100 * common[rest] >= p.percent * (len(own) + n[rows_y[rest]] - common[rest])]
                near = near[np.unique(y_part[near], return_index=True)[1]]
                a += [x["id"].iloc[i]] * len(near)
                b += y_id[near].tolist()
        k.rest()
        return pd.DataFrame({"a": a, "b": b}).astype("int64")

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema} | {"ask": "long", "tell": "long", "asks": "boolean"}
    more = [*take, "n_shingles", "sig"]
    left = cut(asks.select(more).unionByName(tells.select(more)).groupBy(block).applyInPandas(prune, ", ".join(f"{c} {kinds[c]}" for c in take)))
    texts = texts_of(docs, left.select("id").distinct(), max_bits)
    return left.join(texts, "id").groupBy(block).applyInPandas(compare, "a long, b long")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Near = Near()) -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row of df.

    Words are runs of characters other than space and U+0009..U+000D, in lower case for A-Z. A text's set holds its distinct
    shingles of params.words words; a text with fewer words has one, its whole sequence; a text without words, or null, has
    none and links with nothing. Two texts link when their sets' Jaccard similarity is at least params.percent / 100, confirmed
    on the full sets. component_id is the smallest id reachable over links, kept whether that is the row itself.
    Rows that repeat an id and its text share a decision; null ids link with nothing. An empty table gives an empty result.

    Equal sets are one class and act as one text from then on. A text is first compared with one hub, of the smallest ids of
    its buckets the one that it shares most with. What is then outside a bucket's hub's component meets all other components
    of that bucket (in a bucket of two: its hub), so groups of near-copies cost about their size, and no candidate
    link between different components is left out.
    """
    p = params
    small_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = cut(signatures(docs, p))
    classes = signed.where("n_shingles > 0 and id is not null").groupBy("n_shingles", "set_a", "set_b").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"))
    classes = cut(classes)
    reps = classes.select(F.col("rep").alias("id"), "n_shingles", "sig")
    dealt = cut(buckets(reps, p))
    hubs = cut(dealt.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1"))
    members = cut(with_group(dealt, hubs, "bucket", "n", hubs.agg(F.sum("n")).first()[0] or 0))
    pairs = members.where("id <> hub").groupBy(F.col("hub").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("shared"))
    first = cut(pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")).select("a", "b"))
    links = cut(verified(plausible(first, reps, p), docs, p))
    parts = cut(components(links))
    named = members.join(parts, "id", "left").select("bucket", "id", "hub", "n", F.coalesce("component_id", "id").alias("component_id"))
    named = named.join(parts.select(F.col("id").alias("hub"), F.col("component_id").alias("hub_component")), "hub", "left").withColumn("hub_component", F.coalesce("hub_component", "hub"))
    named = cut(named)
    alone = named.where("n = 2 and component_id <> hub_component").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    links = links.unionByName(verified(plausible(alone, reps, p), docs, p)).unionByName(unsettled(named.where("n > 2").drop("hub", "n"), reps, docs, p))
    parts = components(links).withColumnRenamed("id", "rep")
    named = classes.join(parts, "rep", "left").select("n_shingles", "set_a", "set_b", F.coalesce("component_id", "rep").alias("component_id"))
    out = signed.select("id", "n_shingles", "set_a", "set_b").join(named, ["n_shingles", "set_a", "set_b"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select("id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def drop_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Near = Near(), max_bits: int = 1 << 30) -> DataFrame:
    """df without the rows that near_dedup does not keep. A bitmap of the dropped ids lets all other rows pass without a shuffle."""
    gone = cut(near_dedup(df, id_col, text_col, params).where("not kept").select(F.col("id").alias("_gone")).distinct())
    n_bits = min(max_bits, max(1 << 15, 32 * gone.count()))
    marks = gone.select(F.explode(F.array(*cells(F.col("_gone"), n_bits, 2))).alias("cell")).distinct()
    bitmaps = marks.groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).cast("long").alias("_id"))
    marked = possibly_repeated(packed, "_id", cut(bitmaps), n_bits)
    rest = marked.where("maybe").join(gone, F.col("_id") == F.col("_gone"), "left_anti")
    return marked.where("not maybe").unionByName(rest).select("row.*")
