"""Removal of repeated byte strings, by hash-compared suffix sorting of the neighbourhoods of shared anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as k
from tessera.llm.common import cut
from tessera.llm.exact_dedup import cells, possibly_repeated

PIECE = 1 << 18
NO_ID = -(1 << 63)


@dataclass(frozen=True)
class Repeats:
    """length: of the strings, in bytes. gram: bytes of an anchor. filter_bits: of the bitmap of repeated anchors (2**28 bits: 32 MB).

    hot: an anchor seen more often is dealt by longer strings around it. flush: rows that a task gathers before it passes them on.
    """

    length: int = 100
    gram: int = 32
    filter_bits: int = 28
    hot_bits: int = 24
    hot: int = 20_000
    flush: int = 40_000

    @property
    def grams(self) -> int:
        """Grams in one string."""
        return self.length - self.gram + 1


def sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each `width` neighbours, from prefix and suffix minima of blocks."""
    n = len(x) - width + 1
    fill = np.iinfo(np.uint64).max if least else 0
    padded = np.full(-(-len(x) // width) * width, fill, np.uint64)
    padded[: len(x)] = x
    blocks, op = padded.reshape(-1, width), np.minimum if least else np.maximum
    left = op.accumulate(blocks, axis=1).ravel()
    right = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(right[:n], left[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, p: Repeats) -> tuple[np.ndarray, ...]:
    """(hash, text number, position, first and last string) of each anchor, positions in data.

    The anchor of a string is its gram of least hash, the leftmost of equal ones. Equal strings have equal anchors at equal
    places, and the strings with one anchor are neighbours: each string of each text belongs to exactly one anchor.
    """
    none = np.zeros(0, np.int64)
    if len(data) < p.length:
        return none.astype(np.uint64), none, none, none, none
    prefix, n = k.Prefix(data), len(data) - p.length + 1
    at = np.arange(len(data) - p.gram + 1)
    h = k.mix(prefix.range(at, at + p.gram))
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    valid = owner[:n] == owner[p.length - 1 :]
    low = sliding(h, p.grams, True)
    low[~valid] = 0
    edge = np.zeros(p.grams - 1, np.uint64)
    chosen = np.flatnonzero(sliding(np.concatenate([edge, low, edge]), p.grams, False)[: len(h)] == h)
    if not len(chosen):
        return none.astype(np.uint64), none, none, none, none
    strings = np.flatnonzero(valid)
    slot = np.searchsorted(chosen, strings)
    off = np.flatnonzero(h[chosen[slot]] != low[strings])
    while len(off):
        slot[off] += 1
        off = off[h[chosen[slot[off]]] != low[strings[off]]]
    anchor = chosen[slot]
    new = np.ones(len(strings), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (strings[1:] != strings[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(strings)]]) - 1
    return h[anchor[first]], owner[strings[first]], anchor[first], strings[first], strings[last]


def repeated_anchors(docs: DataFrame, p: Repeats) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the anchor hashes that occur at least twice, and more than p.hot times; their size is fixed by p.

    Tasks send sorted arrays of (hash, count) by range of the hash, 12 bytes for each anchor; the reducer of a range returns
    its part of the bitmaps. False bits cost time, not correctness.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    range_bits = int(np.clip(np.ceil(np.log2(max(1, size / (1 << 25)))), 4, min(16, p.hot_bits - 3)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def sent() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            at = np.searchsorted(h >> np.uint64(64 - range_bits), np.arange((1 << range_bits) + 1))
            some = np.flatnonzero(at[1:] > at[:-1])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([h[at[i] : at[i + 1]].tobytes() for i in some], pa.binary()), pa.array([n[at[i] : at[i + 1]].astype(np.uint32).tobytes() for i in some], pa.binary())], names=["part", "h", "n"])

        for batch in batches:
            data, offsets = k.bytes_of(k.column(batch, "text"))
            for _, low, high, starts in stretches(offsets, p):
                held.append(anchors(data[low:high], starts, p)[0])
                if sum(map(len, held)) > 40 * p.flush:
                    yield sent()
        if held:
            yield sent()

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        h, n = np.frombuffer(b"".join(group["h"]), np.uint64), np.frombuffer(b"".join(group["n"]), np.uint32).astype(np.int64)
        order = np.argsort(h)
        h, n = h[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        h, n = h[first], np.add.reduceat(n, first) if len(first) else n

        def bits(found: np.ndarray, width: int) -> bytes:
            out = np.zeros(1 << (width - range_bits), bool)
            out[((found >> np.uint64(64 - width)) & np.uint64((1 << (width - range_bits)) - 1)).astype(np.int64)] = True
            return np.packbits(out, bitorder="little").tobytes()

        return pd.DataFrame({"part": [int(key[0])], "bits": [bits(h[n > 1], p.filter_bits)], "hot": [bits(h[n > p.hot], p.hot_bits)]})

    parts = docs.select("text").mapInArrow(count, "part int, h binary, n binary").groupBy("part").applyInPandas(merge, "part int, bits binary, hot binary")
    repeated, hot = (np.zeros((1 << range_bits, (1 << (w - range_bits)) // 8), np.uint8) for w in (p.filter_bits, p.hot_bits))
    for r in parts.toLocalIterator():
        repeated[r["part"]] = np.frombuffer(r["bits"], np.uint8)
        hot[r["part"]] = np.frombuffer(r["hot"], np.uint8)
    return repeated.ravel(), hot.ravel()


def test(bits: np.ndarray, width: int, h: np.ndarray) -> np.ndarray:
    at = (h >> np.uint64(64 - width)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of data, one after the other, and their offsets; in runs of about a MB, as each byte needs an index meanwhile."""
    length = end - start
    at = np.concatenate([[0], np.cumsum(length)])
    out = np.empty(at[-1], np.uint8)
    for a, b in k.pieces(at, 1 << 20):
        out[at[a] : at[b]] = data[np.arange(at[a], at[b]) - np.repeat(at[a:b] - start[a:b], length[a:b])]
    return out, at


def stretches(offsets: np.ndarray, p: Repeats) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(first text, start and end in bytes, offsets from start) of runs of whole texts; a long text comes in stretches that overlap by less than a string."""
    for a, b in k.pieces(offsets, PIECE):
        low, high = int(offsets[a]), int(offsets[b])
        if b > a + 1 or high - low <= 2 * PIECE:
            yield a, low, high, offsets[a : b + 1] - low
        else:
            for at in range(low, high - p.length + 1, PIECE):
                end = min(high, at + PIECE + p.length - 1)
                yield a, at, end, np.array([0, end - at])


def classes(key: np.ndarray, data: np.ndarray, at: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each row the first row with its key, bytes and anchor place; equal hashes are verified byte by byte."""
    start, end = at[:-1], at[1:]
    h = k.mix(k.mix(k.Prefix(data).range(start, end) + k.mix(key)) + (place * 4096 + (end - start)).astype(np.uint64))
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    found = first[inverse]
    other = np.flatnonzero(found != np.arange(len(h)))
    if len(other):
        same = (key[other] == key[found[other]]) & (place[other] == place[found[other]]) & (np.diff(at)[other] == np.diff(at)[found[other]])
        bad = other[~same]
        good = other[same]
        x, _ = gather(data, start[good], end[good])
        y, cuts = gather(data, start[found[good]], end[found[good]])
        wrong = np.add.reduceat((x != y).astype(np.int64), cuts[:-1]) > 0 if len(good) else np.zeros(0, bool)
        for i in np.concatenate([bad, good[wrong]]):  # a collision: the row stands for itself
            found[i] = i
    return found


class Suffixes:
    """Suffixes of byte ranges, compared by prefix hashes: a binary search finds how far two agree."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.data, self.start, self.end, self.prefix = data, start, end, k.Prefix(data)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(i), np.int64), np.minimum(self.end[i] - self.start[i], self.end[j] - self.start[j])
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.prefix.range(self.start[i], self.start[i] + mid) == self.prefix.range(self.start[j], self.start[j] + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i is smaller than j; of equal ones, neither."""
        n = self.common(i, j)
        x, y = self.start[i] + n, self.start[j] + n
        end_x, end_y = x >= self.end[i], y >= self.end[j]
        byte = np.concatenate([self.data, [0]])
        return np.where(end_x | end_y, end_x & ~end_y, byte[np.minimum(x, len(self.data))] < byte[np.minimum(y, len(self.data))])

    def sort(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mergesort of each group's suffixes (groups are runs) and the agreement of each with the one before; 0 where a group starts.

        Runs of all groups double together: a suffix's place in the merged run is its place in its own run and the number of
        smaller ones in the sibling run, which a binary search counts.
        """
        n = len(group)
        first = np.concatenate([[True], group[1:] != group[:-1]]) if n else np.zeros(0, bool)
        begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        size = np.bincount(np.cumsum(first) - 1)[np.cumsum(first) - 1] if n else np.zeros(0, np.int64)
        order, width = np.arange(n), 1
        while n and width < size.max():
            slot = np.flatnonzero(size > width)
            base, within = begin[slot], slot - begin[slot]
            run = within // width
            low = np.minimum(base + (run ^ 1) * width, base + size[slot])
            high = np.minimum(low + width, base + size[slot])
            start, right = low.copy(), run & 1 == 1
            while (low < high).any():
                go = np.flatnonzero(low < high)
                mid = (low[go] + high[go]) >> 1
                own, other = order[slot[go]], order[mid]
                a, b = np.where(right[go], own, other), np.where(right[go], other, own)
                before = self.less(a, b) ^ right[go]  # left rows precede equal right ones
                low[go], high[go] = np.where(before, mid + 1, low[go]), np.where(before, high[go], mid)
            place = base + (run >> 1) * 2 * width + within % width + (low - start)
            merged = order.copy()
            merged[place] = order[slot]
            order, width = merged, 2 * width
        agree = np.zeros(n, np.int64)
        later = np.flatnonzero(~first)
        if len(later):
            i, j = order[later - 1], order[later]
            agree[later] = self.common(i, j)
            x, at = gather(self.data, self.start[i], self.start[i] + agree[later])
            y, _ = gather(self.data, self.start[j], self.start[j] + agree[later])
            wrong = np.flatnonzero(x != y)
            if len(wrong):  # colliding hashes: sort these rows by their bytes instead
                return self.plain(group)
        return order, agree

    def plain(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = [self.data[a:b].tobytes() for a, b in zip(self.start, self.end, strict=True)]
        order = np.array(sorted(range(len(own)), key=lambda i: (group[i], own[i], i)))
        agree = np.zeros(len(own), np.int64)
        for t in range(1, len(own)):
            x, y = own[order[t - 1]], own[order[t]]
            if group[order[t - 1]] == group[order[t]]:
                agree[t] = next((i for i, (c, d) in enumerate(zip(x, y, strict=False)) if c != d), min(len(x), len(y)))
        return order, agree


def repeated_spans(key: np.ndarray, doc: np.ndarray, a: np.ndarray, s: np.ndarray, e: np.ndarray, data: np.ndarray, at: np.ndarray, p: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) of what repeats an earlier string, from whole groups of rows in order of (key, doc, a)."""
    found = classes(key, data, at, a - s)
    copy = (found != np.arange(len(key))) & ((doc != doc[found]) | (a != a[found]))
    out = [(doc[copy], s[copy], e[copy] + p.length)]
    kept = np.flatnonzero(found == np.arange(len(key)))
    _, inverse, n = np.unique(key[kept], return_inverse=True, return_counts=True)
    kept = kept[n[inverse] > 1]
    if len(kept):
        key, doc, a, s, e = key[kept], doc[kept], a[kept], s[kept], e[kept]
        middle = at[:-1][kept] + a - s
        total = len(data)
        right_order, right = Suffixes(data, middle, at[1:][kept]).sort(key)
        left_order, left = Suffixes(data[::-1].copy(), total - middle, total - at[:-1][kept]).sort(key)
        first = np.concatenate([[True], key[1:] != key[:-1]])
        again = np.zeros((len(key), p.grams), bool)
        for back in range(p.grams):  # strings that start so many bytes before the anchor
            holds = np.flatnonzero((a - back >= s) & (a - back <= e))
            if len(holds) < 2:
                continue
            side = []
            for order, agree, depth in ((left_order, left, back), (right_order, right, p.length - back)):
                number = np.empty(len(key), np.int64)
                number[order] = np.cumsum(first | (agree < depth))
                side.append(number)
            code = (side[0] * (len(key) + 1) + side[1])[holds]
            _, earliest, inverse = np.unique(code, return_index=True, return_inverse=True)
            earliest = holds[earliest[inverse]]
            again[holds, back] = (earliest != holds) & ((doc[holds] != doc[earliest]) | (a[holds] != a[earliest]))
        edge = np.diff(np.pad(again.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, low = np.nonzero(edge == 1)
        _, high = np.nonzero(edge == -1)
        out.append((doc[row], a[row] - high + 1, a[row] - low + p.length))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def neighbourhoods(docs: DataFrame, repeated: np.ndarray, hot: np.ndarray, p: Repeats) -> DataFrame:
    """(key, id, a, s, e, ctx) of possibly repeated anchors; ctx holds the bytes of all their strings.

    The anchor's hash is the key. For a hot anchor it is the hash of the longer piece of text that either half of its strings
    share, so that a common line does not bring together texts that agree in nothing else. Of rows alike in key and bytes a
    task sends the bytes once; the others are settled (ctx is null).
    """
    shared = docs.sparkSession.sparkContext.broadcast((repeated, hot))
    half = (p.grams - 1) // 2

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot_bits = shared.value
        held: list[tuple[np.ndarray, ...]] = []

        def sent() -> pa.RecordBatch:
            key, doc, a, s, e = (np.concatenate([x[i] for x in held]) for i in range(5))
            data, at = np.concatenate([x[5] for x in held]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x[6]) for x in held]))])
            held.clear()
            order = np.lexsort((a, doc, key))
            data, at = gather(data, at[:-1][order], at[1:][order])
            key, doc, a, s, e = key[order], doc[order], a[order], s[order], e[order]
            found = classes(key, data, at, a - s)
            own = (found == np.arange(len(key))) | (doc == doc[found]) & (a == a[found])
            key = np.where(own, key, doc.view(np.uint64))  # settled rows need not meet
            buffers = [pa.py_buffer(np.packbits(own, bitorder="little").tobytes()), pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]
            ctx = pa.Array.from_buffers(pa.binary(), len(key), buffers)
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc), pa.array(a, pa.int32()), pa.array(s, pa.int32()), pa.array(e, pa.int32()), ctx], names=["key", "id", "a", "s", "e", "ctx"])

        for batch in batches:
            data, offsets = k.bytes_of(k.column(batch, "text"))
            ids = k.column(batch, "id").to_numpy()
            for i, low, high, starts in stretches(offsets, p):
                own, shift = data[low:high], low - offsets[i]
                h, text, a, s, e = anchors(own, starts, p)
                some = test(bits, p.filter_bits, h)
                h, text, a, s, e = h[some], text[some], a[some], s[some], e[some]
                busy = test(hot_bits, p.hot_bits, h)
                rows = [(h[~busy], text[~busy], a[~busy], s[~busy], e[~busy])]
                if busy.any():
                    prefix, bh, bt, ba, bs, be = k.Prefix(own), h[busy], text[busy], a[busy], s[busy], e[busy]
                    for near, lowest, highest, x, y in ((1, ba - half, ba, ba, ba + p.length - half), (2, ba - p.grams + 1, ba - half - 1, ba - half - 1, ba + p.gram)):
                        first, last = np.maximum(bs, lowest), np.minimum(be, highest)
                        ok = first <= last
                        rows.append((k.mix(bh[ok] + k.mix(prefix.range(x[ok], y[ok])) * np.uint64(2 * near + 1)), bt[ok], ba[ok], first[ok], last[ok]))
                key, text, a, s, e = (np.concatenate(x) for x in zip(*rows, strict=True))
                bytes_, at = gather(own, s, e + p.length)
                begin = starts[text] - shift
                held.append((key, ids[i + text], a - begin, s - begin, e - begin, bytes_, at))
                if sum(len(x[0]) for x in held) > p.flush:
                    yield sent()
        if held:
            yield sent()

    return docs.mapInArrow(emit, "key long, id long, a int, s int, e int, ctx binary")


def spans(rows: DataFrame, p: Repeats) -> DataFrame:
    """(id, start, stop) of removed bytes, from neighbourhoods; the groups of a partition are taken in turn."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(table: pa.Table) -> pa.RecordBatch:
            key, doc = table["key"].to_numpy().view(np.uint64), table["id"].to_numpy()
            a, s, e = (table[c].to_numpy().astype(np.int64) for c in "ase")
            ctx = table["ctx"].combine_chunks()
            known = ctx.is_null().to_numpy(zero_copy_only=False)
            data, at = k.bytes_of(ctx.filter(pa.array(~known)).cast(pa.large_binary()).view(pa.large_string()))
            d, x, y = repeated_spans(key[~known], doc[~known], a[~known], s[~known], e[~known], data, at, p)
            d, x, y = np.concatenate([d, doc[known]]), np.concatenate([x, s[known]]), np.concatenate([y, e[known] + p.length])
            return pa.RecordBatch.from_arrays([pa.array(d), pa.array(x, pa.int32()), pa.array(y, pa.int32())], names=["id", "start", "stop"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) > p.flush:
                table = pa.Table.from_batches(held)
                key = table["key"].to_numpy()
                end = int(np.searchsorted(key, key[-1]))  # the last group may go on
                if end:
                    yield out(table.slice(0, end))
                    held = table.slice(end).combine_chunks().to_batches()
        if held:
            yield out(pa.Table.from_batches(held))

    return rows.repartition("key").sortWithinPartitions("key", "id", "a").mapInArrow(settle, "id long, start int, stop int")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Repeats = Repeats()) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, removed) of each row: what is left without repeated strings.

    Each text counts as UTF-8 bytes (null: none); strings never cross texts. A byte goes if a string of params.length bytes that
    covers it also starts earlier: in a row of smaller id, or earlier in the same one. Overlaps count, and strings are judged on
    the input. `removed` lists the maximal removed runs as (start, stop). A null id counts as the smallest. Rows that repeat an
    id and its text are one text. Texts shorter than params.length lose nothing. An empty table gives an empty result.
    """
    p = params
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    repeated, hot = repeated_anchors(docs, p)
    found = spans(neighbourhoods(docs, repeated, hot, p), p)
    found = cut(found.groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("spans")))  # no more than a text has anchors
    n_bits = min(1 << 30, max(1 << 15, 32 * found.count()))
    marks = found.select(F.explode(F.array(*cells(F.col("id"), n_bits, 2))).alias("cell")).distinct()
    bitmaps = marks.groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
    marked = possibly_repeated(docs, "id", cut(bitmaps), n_bits)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = k.bytes_of(k.column(batch, "text"))
            rows = []
            for i, own in enumerate(k.column(batch, "spans").to_pylist()):
                text = data[offsets[i] : offsets[i + 1]]
                edge = np.zeros(len(text) + 1, np.int32)
                if own:
                    np.add.at(edge, [x["start"] for x in own], 1)
                    np.add.at(edge, [x["stop"] for x in own], -1)
                gone = np.cumsum(edge[:-1]) > 0
                step = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                runs = [{"start": int(x), "stop": int(y)} for x, y in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)]
                rows.append((len(text), int(gone.sum()), len(runs), hashlib.sha256(text[~gone].tobytes()).hexdigest(), runs))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([k.column(batch, "id"), *(pa.array(cols[i], pa.int64()) for i in range(3)), pa.array(cols[3], pa.string()), pa.array(cols[4], kind)], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    kind = "array<struct<start:int,stop:int>>"
    some = marked.where("maybe").join(found, "id", "left").select("id", "text", "spans").mapInArrow(cut_out, f"id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed {kind}")
    zero = F.lit(0).cast("long")
    rest = marked.where("not maybe").select("id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.array().cast(kind).alias("removed"))
    return some.unionByName(rest).withColumn("id", F.nullif("id", F.lit(NO_ID)))
