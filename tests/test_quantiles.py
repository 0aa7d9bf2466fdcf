"""Quantiles by ranges against NumPy."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.operators.quantiles import quantile_columns, quantiles

AT = [0.0, 0.05, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_groups(spark, ranges):
    """Ties, one value, nulls, NaN, infinities, a null group; more ranges than values."""
    rng = np.random.default_rng(1)
    columns = {"ties": rng.integers(0, 5, 400).astype(float), "wide": rng.normal(size=301) * 1e6, "one": np.array([3.5]), "two": np.array([1.0, 2.0]), "same": np.full(90, -2.0), None: rng.random(20), "ends": np.array([-np.inf, 0.0, 1.0, np.inf])}
    rows = [(g, float(v)) for g, x in columns.items() for v in x] + [("one", None), ("two", float("nan")), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = {(r.g, r.q): r.value for r in quantiles(df, "v", AT, ("g",)).collect()}
        whole = {r.q: r.value for r in quantiles(df.where("g <> 'ends'"), "v", AT).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert set(got) == {(g, q) for g in columns for q in AT}
    for g, x in columns.items():
        for q in AT:
            want = float(np.quantile(x, q)) if g != "ends" else None
            if want is not None:
                assert got[g, q] == pytest.approx(want, rel=1e-12), (g, q)
    x = np.concatenate([v for g, v in columns.items() if g not in ("ends", None)])
    assert all(whole[q] == pytest.approx(float(np.quantile(x, q)), rel=1e-12) for q in AT)


def test_columns_at_once(spark):
    df = spark.range(101).selectExpr("id % 2 as g", "id as a", "id * 2 as b")
    got = {r.g: (r.low, r.mid) for r in quantile_columns(df, {"low": ("a", 0.1), "mid": ("b", 0.5)}, ("g",)).collect()}
    assert got == {0: (10.0, 100.0), 1: (pytest.approx(10.8), 100.0)}
    one = quantile_columns(df, {"mid": ("a", 0.5)}).collect()
    assert [tuple(r) for r in one] == [(50.0,)] and [tuple(r) for r in quantile_columns(df.limit(0), {"mid": ("a", 0.5)}).collect()] == [(None,)]


def test_no_aggregate_over_raw_values(spark):
    """Neither a percentile buffer nor one task for all rows."""
    plan = quantiles(spark.range(1000).withColumnRenamed("id", "v"), "v", [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan.lower()
