"""Queries over all pairs: against loops, and dealt to blocks however few bytes their rows have."""

from __future__ import annotations

import numpy as np
import pytest

from tessera import plans
from tessera.operators import reports


def test_cohesion(spark):
    rng = np.random.default_rng(3)
    rows = [(i, 1 if i < 90 else 2 if i < 96 else 3 if i == 96 else None, [float(x) for x in rng.standard_normal(5) + 0.5]) for i in range(100)]
    rows[4], rows[5], rows[7] = (4, 1, None), (5, 1, [0.0] * 5), (7, 1, [1.0, None, 0.0, 0.0, 0.0])
    rows += [(200 + i, 4, [1.0, 2.0, 0.0, 0.0, 0.0]) for i in range(30)] + [(200, 4, [2.0, 1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, label int, v array<double>").repartition(5)
    got = {r.label: r for r in reports.cohesion(df, cells=64, block=16).collect()}
    assert set(got) == {1, 2, 4}
    for label, r in got.items():
        own = [(i, None if v is None or None in v or not any(v) else np.array(v) / np.linalg.norm(v)) for i, at, v in rows if at == label]
        pairs = [None if x is None or y is None else float(x @ y) for i, x in own for j, y in own if i < j]
        known = np.array([s for s in pairs if s is not None])
        assert r.pairs == len(pairs)
        assert [r["mean"], r.deviation, r.least, r.p10] == pytest.approx([known.mean(), known.std(), known.min(), np.quantile(known, 0.1)], abs=1e-9)


def test_cohesion_of_unknown_scores(spark):
    df = spark.createDataFrame([(1, 1, [0.0]), (2, 1, [1.0])], "id long, label int, v array<double>")
    assert [tuple(r) for r in reports.cohesion(df).collect()] == [(1, 1, None, None, None, None)]
    assert reports.cohesion(df.where("id = 1")).count() == 0


def test_unordered_pairs_in_blocks(spark):
    rows = [(1 if i < 60 else i % 3 + 2 if i < 70 else None, i) for i in range(75)] + [(1, 5), (1, None)]
    found = reports.unordered_pairs(spark.createDataFrame(rows, "owner int, k long"), "owner", "k", block=8)
    known = [(o, k) for o, k in rows if o is not None and k is not None]
    assert sorted(map(tuple, found.collect())) == sorted((o, j, k) for o, j in known for p, k in known if o == p and j < k)


def test_pair_trials_in_blocks(spark):
    rows = [(i, None if i == 3 else i % 4, "none") for i in range(50)]
    found = reports.role_trials(spark.createDataFrame(rows, "k long, s int, role string"), "k", "s", "role", 8)
    speaker = {k: s for k, s, _ in rows}
    want = {(a, b): None if None in (speaker[a], speaker[b]) else int(speaker[a] == speaker[b]) for a in speaker for b in speaker if a < b}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and {(a, b): same for a, b, same in got} == want


def test_pairs_are_dealt(spark):
    """Few bytes, many pairs: one task had them all."""
    rows = spark.range(4000).selectExpr("id as k", "1 as owner", "'none' as role")
    for found in (reports.unordered_pairs(rows, "owner", "k"), reports.role_trials(rows, "k", "owner", "role", 256)):
        assert found.rdd.getNumPartitions() >= 4 and found.count() == 4000 * 3999 // 2


def test_enrolments_in_blocks(spark, tmp_path):
    spark.range(9000).selectExpr("id as s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    found = plans.QUERIES["j9_enrol_test_all"](spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 5
    assert found.selectExpr("count(distinct enrol, test)", "count(*)", "count_if(enrol % 10 <> 0 or enrol = test)").first()[:] == (900 * 8999, 900 * 8999, 0)
