"""Embedding near-dedup: an inverted multi-index over vector halves, visited nearest cell first, then exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as k
from tessera.llm.common import bounded_sample, cut
from tessera.operators.components import components


@dataclass(frozen=True)
class MultiIndex:
    """cosine: least of a link. codes: most centres of a half's codebook; fewer where a label's cells would hold less than half a
    block. sample: most vectors that codebooks are fitted on. recall: expected part of the links that are compared; 1 compares
    all. block: vectors of a cell compared in one group.
    """

    cosine: float = 0.98
    codes: int = 256
    sample: int = 20_000
    recall: float = 0.9999
    block: int = 1024

    def reach(self, width: int) -> float:
        """Squared distance up to which cells are visited.

        Two linked vectors are at most 2 - 2 cosine apart (squared). If x lies a from the border between their cells and y lies b
        (in each half), a + b is at most their distance across it, so the smaller of the two squares is at most half of the
        squared distance: the reach at recall 1, as a pair is compared when either visits the other's cell. Else the difference
        of two linked vectors is taken to have no favoured direction: its part across the two nearest borders then is chi-square
        with two degrees of freedom, times the squared distance over the dimensions, and the reach is half the quantile of recall.
        """
        far = 2 - 2 * self.cosine
        return (far if self.recall >= 1 else min(far, -2 * math.log(1 - self.recall) * far / width)) / 2 + 1e-9


def codebook(x: np.ndarray, codes: int, steps: int = 12) -> np.ndarray:
    """Centres of k-means, from evenly spaced rows; an empty centre keeps its place."""
    centres = x[np.linspace(0, len(x) - 1, min(codes, len(x))).astype(int)].copy()
    for _ in range(steps):
        near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(axis=1)
        n = np.bincount(near, minlength=len(centres))
        for j in np.flatnonzero(n):
            centres[j] = x[near == j].mean(axis=0)
    return centres


def unit_rows(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows usable for cosine (of equal length, non-zero, all components finite), their unit vectors in double precision, and their row numbers."""
    rows = vectors.to_pylist()
    length = max((len(v) for v in rows if v), default=0)
    fit = [i for i, v in enumerate(rows) if v and len(v) == length and None not in v]
    x = np.array([rows[i] for i in fit], np.float64).reshape(len(fit), length)
    finite = np.isfinite(x).all(axis=1)
    x, fit = x[finite], np.array(fit, np.int64)[finite]
    some = np.abs(x).max(axis=1, initial=0.0) > 0
    return unit_of(x[some]), fit[some]


def unit_of(x: np.ndarray) -> np.ndarray:
    """Rows brought to length one, in double precision, whatever their magnitude."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0.0)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Cells:
    """Two codebooks, one for each half of the vectors, and the walk over their product grid."""

    def __init__(self, first: np.ndarray, second: np.ndarray, p: MultiIndex):
        self.books, self.p = (first, second), p
        self.gap = [np.sqrt(np.maximum(((b[:, None] - b[None]) ** 2).sum(-1), 0)) for b in self.books]

    def bounds(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each half: the nearest centre of each unit vector, and the least squared distance to where each centre is the nearest.

        A half whose nearest centre is c lies at least (d(x, c)**2 - d(x, own)**2) / (2 d(c, own)) away.
        """
        half = x.shape[1] // 2
        own, low = [], []
        for part, centres, gap in zip((x[:, :half], x[:, half:]), self.books, self.gap, strict=True):
            d = np.maximum((part**2).sum(1)[:, None] - 2 * part @ centres.T + (centres**2).sum(1), 0)
            near = d.argmin(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                away = (d - d[np.arange(len(d)), near][:, None]) / (2 * gap[near])
            own.append(near)
            low.append(np.where(gap[near] > 0, np.maximum(away, 0), 0) ** 2)
        return own, low

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The cell of each unit vector, and the cells that it visits, nearest first.

        Cells come in order of the two halves' bounds together (the multi-sequence order); the walk ends at the reach for the
        target recall. At recall 1 no link can be lost.
        """
        reach, width = self.p.reach(x.shape[1]), len(self.books[1])
        own, low = self.bounds(x)
        order = [b.argsort(axis=1, kind="stable") for b in low]
        bound = [np.take_along_axis(b, o, axis=1) for b, o in zip(low, order, strict=True)]
        out = []
        for i in range(len(x)):
            a, b = bound[0][i], bound[1][i]
            rows, cols = int(np.searchsorted(a, reach, side="right")), int(np.searchsorted(b, reach, side="right"))
            total = a[:rows, None] + b[None, :cols]
            r, c = np.nonzero(total <= reach)
            walk = total[r, c].argsort(kind="stable")
            out.append(order[0][i][r[walk]] * width + order[1][i][c[walk]])
        return own[0] * width + own[1], out

    def visited(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Whether the walk of each unit vector (row) comes to each of the cells (column)."""
        _, low = self.bounds(x)
        width = len(self.books[1])
        return low[0][:, cells // width] + low[1][:, cells % width] <= self.p.reach(x.shape[1])


def fit(vectors: DataFrame, p: MultiIndex) -> Cells | None:
    """Codebooks from about p.sample vectors, chosen by a hash of id, which reach the driver. None without a usable vector."""
    most = vectors.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    rows = [r["v"] for r in bounded_sample(vectors, F.col("id"), p.sample).select("v").toLocalIterator()]
    x, _ = unit_rows(pa.array(rows, pa.list_(pa.float64())))
    if not len(x):
        return None
    half, codes = x.shape[1] // 2, min(p.codes, max(2, math.ceil(math.sqrt(2 * most / p.block))))
    return Cells(codebook(x[:, :half], codes), codebook(x[:, half:], codes), p)


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", params: MultiIndex = MultiIndex()) -> DataFrame:
    """(id, n_links, component_id, kept) of each row: links of cosine >= params.cosine between rows of equal label.

    Null labels and vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of different
    lengths do not link. n_links counts the other vectors linked directly; component_id is the smallest id reachable, the row's
    own without links; kept tells whether that is the row. A row that repeats an id counts as one more vector. An empty table gives an empty result.

    Equal unit vectors of a label are one class, which counts as often as it has rows. Every class lies in one cell of its label
    and visits the cells within reach; a pair is compared if either visits the other's cell, and counted once for both. Classes
    of a cell are dealt to blocks, visitors to each block, so neither a hot label nor a hot cell meets in one task. A group
    returns link counts and a spanning forest of its links, never all pairs. Vectors of another length than most of the sample
    have a cell of their own by length.
    """
    p = params
    element = "float" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    kind = np.float32 if element == "float" else np.float64
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{element}>").alias("v"), F.col(label_col).alias("label"))
    usable = cut(rows.where("id is not null and label is not null and v is not null and size(v) > 0"))
    index = fit(usable, p)
    label_type = rows.schema["label"].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(index)
    width = len(index.books[0][0]) + len(index.books[1][0]) if index else 0

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, out = k.column(batch, "v"), []
            size = np.array([len(x) for x in v.to_pylist()], np.int64)
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                x, fitting = unit_rows(v.take(pa.array(at)))
                at = at[fitting]
                own, walk = shared.value.visits(x) if n == width else (np.full(len(x), -n), [np.array([-n])] * len(x))
                raw = v.take(pa.array(at)).to_pylist()
                out += [(int(i), int(c), w.tolist(), blake2b(u.tobytes(), digest_size=16).digest(), np.array(r, kind).tobytes()) for i, c, w, u, r in zip(at, own, walk, x, raw, strict=True)]
            take = pa.array([o[0] for o in out], pa.int64())
            more = [pa.array([o[i] for o in out], t) for i, t in ((1, pa.int64()), (2, pa.list_(pa.int64())), (3, pa.binary()), (4, pa.binary()))]
            yield pa.RecordBatch.from_arrays([k.column(batch, "id").take(take), k.column(batch, "label").take(take), *more], names=["id", "label", "cell", "visits", "same", "x"])

    unit = usable.mapInArrow(place, f"id long, label {label_type}, cell long, visits array<long>, same binary, x binary")
    name = ["label", "same"]
    unit = cut(unit)
    members = unit.select("id", *name)
    placed = cut(unit.groupBy(*name).agg(F.min("id").alias("id"), F.count("*").alias("w"), F.first("cell").alias("cell"), F.first("visits").alias("visits"), F.first("x").alias("x")))
    filled = cut(placed.groupBy("label", "cell").agg(F.ceil(F.count("*") / p.block).alias("blocks")))
    filled = F.broadcast(filled) if filled.count() <= 100_000 else filled
    homes = placed.join(filled, ["label", "cell"])
    homes = homes.select("label", "cell", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), F.lit(False).alias("asks"), "id", "w", F.col("cell").alias("own"), "x")
    asks = placed.select("id", "w", "x", "label", F.col("cell").alias("own"), F.explode("visits").alias("cell")).join(filled, ["label", "cell"])
    asks = asks.select("label", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"), "id", "w", "own", "x")
    # Visitors of a block come in parts of about p.block as well; each part meets the whole block.
    parts = cut(asks.groupBy("label", "cell", "block").agg(F.ceil(F.count("*") / p.block).alias("parts")))
    parts = F.broadcast(parts) if parts.count() <= 100_000 else parts
    asks = asks.join(parts, ["label", "cell", "block"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts"))).drop("parts")
    homes = homes.join(parts, ["label", "cell", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        q, d = group[group["asks"]], group[~group["asks"]]
        if not len(q) or not len(d):
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
        xq, xd = (unit_of(np.frombuffer(b"".join(s["x"]), kind).reshape(len(s), -1)) for s in (q, d))
        iq, idd, wq, wd = q["id"].to_numpy(), d["id"].to_numpy(), q["w"].to_numpy(), d["w"].to_numpy()
        near = (xq @ xd.T >= p.cosine) & (iq[:, None] != idd[None])
        # Where a home visits the asking row's cell too, both meet twice: the smaller id counts.
        cells, at = np.unique(q["own"].to_numpy(), return_inverse=True)
        back = shared.value.visited(xd, cells)[:, at].T if xd.shape[1] == width else np.ones(near.shape, bool)
        near &= ~back | (iq[:, None] < idd[None])
        rows, cols = np.nonzero(near)
        names, number = np.unique(np.concatenate([iq, idd]), return_inverse=True)
        r, c = number[: len(q)][rows], number[len(q) :][cols]
        n = np.bincount(r, wd[cols], len(names)) + np.bincount(c, wq[rows], len(names))
        label = np.arange(len(names))  # spanning forest: each takes the least label among its neighbours until none changes
        while len(r):
            new = label.copy()
            np.minimum.at(new, r, label[c])
            np.minimum.at(new, c, label[r])
            if (new == label).all():
                break
            label = new
        linked = np.flatnonzero(n)
        return pd.DataFrame({"a": names[linked], "b": names[label[linked]], "n": n[linked].astype(np.int64)})

    take = ["label", "cell", "block", "part", "asks", "id", "w", "own", "x"]
    found = asks.select(take).unionByName(homes.select(take)).groupBy("label", "cell", "block", "part").applyInPandas(compare, "a long, b long, n long")
    found = cut(found)
    links = found.groupBy("a").agg(F.sum("n").alias("n"))
    groups = placed.select(*name, "w", F.col("id").alias("rep")).join(links.withColumnRenamed("a", "rep"), "rep", "left").join(components(found.select("a", "b")).withColumnRenamed("id", "rep"), "rep", "left")
    groups = groups.select(*name, (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = members.join(groups, name).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    rest = rows.select("id").join(out, "id", "left")
    component = F.coalesce("component_id", "id")
    return rest.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
