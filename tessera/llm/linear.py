"""Sparse logistic regression by follow-the-regularised-leader updates, in shards whose models are averaged."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as k
from tessera.llm.common import cut, small_batches

EXAMPLE = "label int, idx binary, val binary, swap_idx binary, swap_val binary"
#: An example's parts: feature indices and values, and the difference that a counterfactual swap makes (often empty).
Example = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class Leader:
    """State z, n of FTRL-proximal with L1 and L2 regularisation; index 0 is the bias, which is not regularised."""

    def __init__(self, bits: int, alpha: float = 0.2, beta: float = 1.0, l1: float = 0.5, l2: float = 1.0, swap: float = 0.0, positive: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2, self.swap, self.positive = alpha, beta, l1, l2, swap, positive
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(self, idx: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[idx]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[idx])) / self.alpha + self.l2)
        w[np.abs(z) <= self.l1] = 0
        bias = idx == 0 if isinstance(idx, np.ndarray) else np.arange(len(z)) == 0
        w[bias] = -z[bias] * self.alpha / (self.beta + np.sqrt(self.n[0]))
        return w

    def step(self, idx: np.ndarray, gradient: np.ndarray, w: np.ndarray) -> None:
        square = gradient * gradient
        self.z[idx] += gradient - (np.sqrt(self.n[idx] + square) - np.sqrt(self.n[idx])) / self.alpha * w
        self.n[idx] += square

    def learn(self, label: int, example: Example) -> None:
        idx, val, swap_idx, swap_val = example
        w = self.weights(idx)
        p = 1 / (1 + np.exp(-np.clip(w @ val, -35, 35)))
        self.step(idx, (self.positive if label else 1.0) * (p - label) * val, w)
        if self.swap and len(swap_idx):  # the penalty swap * (score of the text - score of its counterpart)**2
            w = self.weights(swap_idx)
            self.step(swap_idx, 2 * self.swap * (w @ swap_val) * swap_val, w)


def train(labelled: DataFrame, features: Callable[[pa.Array], Iterator[Example]], new: Callable[[], Leader], tasks: int = 8, rounds: int = 3, least: int = 1000) -> np.ndarray:
    """Weights fitted on (key, label, text) rows, a bounded sample.

    The sample's features are written once, in shards by a hash of the key: `tasks`, or fewer where these would hold less than
    `least` rows each, as averages of models of a few rows are poor. In each round every shard continues from
    the averaged state over its own rows and returns what it changed; the driver averages at most tasks x 2 x 2**bits numbers,
    whatever the input's size. Shards, the order of rows in them and the order of the averages depend on the rows alone, not on files or partitions.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k.turn_to("linear")
        for batch in batches:
            found = list(features(k.column(batch, "text")))
            pack = lambda i, t: pa.array([x[i].astype(t).tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([k.column(batch, "label").cast(pa.int32()), pack(0, np.int32), pack(1, np.float32), pack(2, np.int32), pack(3, np.float32)], names=["label", "idx", "val", "swap_idx", "swap_val"])

    small_batches(labelled.sparkSession)
    tasks = min(tasks, max(1, labelled.count() // least))
    dealt = labelled.select(F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit("shard")), F.lit(tasks)).cast("int").alias("shard"), "label", "text")
    shards = cut(dealt.repartitionById(tasks, "shard").mapInArrow(extract, EXAMPLE))
    context, leader = labelled.sparkSession.sparkContext, new()
    for turn in range(rounds):
        known = np.flatnonzero(leader.n).astype(np.int32)
        shared = context.broadcast((known, leader.z[known].astype(np.float32), leader.n[known].astype(np.float32)))

        def learn(batches: Iterator[pa.RecordBatch], turn=turn, shared=shared) -> Iterator[pa.RecordBatch]:
            k.turn_to("linear")
            rows = [r for batch in batches for r in batch.to_pylist()]
            rows.sort(key=lambda r: (r["label"], r["idx"], r["val"]))  # whatever order the shuffle brought
            if rows:
                idx, z, n = shard_changes(rows, new(), shared.value, turn)
                yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (idx, z, n))], names=["seen", "idx", "z", "n"])

        # The iterator gives partition after partition, and a partition is a shard: always the same order of sums.
        z, n, seen = np.zeros_like(leader.z), np.zeros_like(leader.n), 0
        for r in shards.mapInArrow(learn, "seen long, idx binary, z binary, n binary").toLocalIterator():
            at = np.frombuffer(r["idx"], np.int32)
            z[at] += r["seen"] * np.frombuffer(r["z"], np.float32)
            n[at] += r["seen"] * np.frombuffer(r["n"], np.float32)
            seen += r["seen"]
        if seen:
            leader.z, leader.n = leader.z + z / seen, leader.n + n / seen
        shared.unpersist()
    return leader.weights()


def shard_changes(rows: list[dict], own: Leader, state: tuple[np.ndarray, ...], turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indices, changes of z, changes of n) that one pass over a shard's rows makes of the state, in an order that the round's number fixes."""
    known, z, n = state
    own.z[known], own.n[known] = z, n
    touched = np.zeros(len(own.z), bool)
    for r in rows:
        touched[np.frombuffer(r["idx"], np.int32)] = True
        touched[np.frombuffer(r["swap_idx"], np.int32)] = True
    changed = np.flatnonzero(touched).astype(np.int32)
    begin_z, begin_n = own.z[changed], own.n[changed]
    for at in np.random.default_rng(turn).permutation(len(rows)):
        r = rows[at]
        own.learn(r["label"], (np.frombuffer(r["idx"], np.int32), np.frombuffer(r["val"], np.float32), np.frombuffer(r["swap_idx"], np.int32), np.frombuffer(r["swap_val"], np.float32)))
    return changed, (own.z[changed] - begin_z).astype(np.float32), (own.n[changed] - begin_n).astype(np.float32)
