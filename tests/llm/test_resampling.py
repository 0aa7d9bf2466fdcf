"""Weights, noise, the k-th key and ranks against plain loops."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, resampling
from tests.llm.fixtures import awkward, nothing

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORDS.findall((text or "").translate(SMALL))
    return len(w), [zlib.crc32(" ".join(w[i : i + m]).encode()) % 10_000 for m in (1, 2, 3) for i in range(len(w) - m + 1)]


def plain(docs, target, share=(5, 100)):
    """(id, n_features, weight, score, rank) of (id, text) rows."""
    own, other = [features(t) for _, t in docs], [features(t) for t in target]
    s, t = (Counter(x for _, f in rows for x in f) for rows in (own, other))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000)))) for b in range(10_000)]
    out = []
    for (i, _), (n, f) in zip(docs, own, strict=True):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: share[0] * len(able) // share[1]]):
        r[4] = rank + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def test_shipped_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = plain(docs, target)
    assert sorted(map(tuple, queries.op13_resampling(spark, sf).collect()), key=repr) == want and sum(r[4] is not None for r in want) >= 5


@pytest.mark.parametrize("share", [(1, 3), (0, 100), (1, 1)])
def test_awkward_rows(spark, share):
    df = awkward(spark)
    more = df.where("doc_id = 7").unionByName(df.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long")))
    df = df.unionByName(more)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = resampling.resample(df, df.where("doc_id < 4"), share=share)
    want = plain(rows, [t for i, t in rows if i is not None and i < 4], share)
    assert sorted((tuple(r) for r in got.select("id", "n_features", "weight", "score", "rank").collect()), key=repr) == want
    if share == (1, 3):
        assert resampling.drawn_rows(df, got).count() >= 1


def test_empty_tables(spark):
    assert resampling.resample(nothing(spark), awkward(spark)).count() == 0
    assert resampling.resample(awkward(spark), nothing(spark)).count() == awkward(spark).count()


def test_checksums():
    rng = np.random.default_rng(1)
    words = ["a", "é" * 40, "x" * 64, "y" * 65, "z" * 5000, "漢字", *("".join(rng.choice(list("abcé0"), int(rng.integers(1, 90)))) for _ in range(200))]
    texts = [" ".join(words), "", "--", " ".join(reversed(words))]
    got = [Counter() for _ in texts]
    for a, _, _, buckets, owners in resampling.buckets_of(pa.array([*texts, None]), 10_000):
        for x, owner in zip(buckets, owners, strict=True):
            for b, i in zip(x.tolist(), owner.tolist(), strict=True):
                got[a + i][b] += 1
    assert got == [Counter(features(t)[1]) for t in texts]


def test_kth_key(spark):
    """Radix selection over negative and equal scores, for every number of rows."""
    rng = np.random.default_rng(2)
    rows = [(int(s), i % 7, i) for i, s in enumerate(np.concatenate([rng.integers(-(10**12), 10**12, 60), np.full(40, -5), [2**61, -(2**61)]]))]
    df = spark.createDataFrame(rows, "score long, id long, place long").cache()
    order = sorted(rows, key=lambda r: (-r[0], r[1], r[2]))
    for n in (0, 1, 2, 31, 33, 60, 75, 101, 102, 500):
        got = df.where(resampling.select_first(df, [("score", True), ("id", False), ("place", False)], n)).collect()
        assert sorted(map(tuple, got)) == sorted(order[:n])
