"""Every query with SQL against DuckDB over the smallest tables; the others against their own invariants."""

from __future__ import annotations

import decimal

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessera import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    """A value as both engines give it: None for missing ones, numbers as floats with six decimals."""
    if isinstance(v, (list, tuple, np.ndarray)):
        return str([plain(x) for x in v])
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and np.isnan(v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating, decimal.Decimal)):
        return round(float(v), 6)
    return str(v)


def same_rows(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    names = sorted(got.columns)
    order = lambda rows: sorted(rows, key=lambda r: [(v is not None, isinstance(v, str), v if v is not None else 0) for v in r])
    a, b = (order([tuple(plain(v) for v in r) for r in df[names].itertuples(index=False, name=None)]) for df in (got, want))
    for x, y in zip(a, b, strict=True):
        for c, v, w in zip(names, x, y, strict=True):
            assert v == w or isinstance(v, float) and isinstance(w, float) and abs(v - w) <= 2e-6, (c, x, y)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_as_sql(spark, sf, duck, name):
    same_rows(plans.QUERIES[name](spark, sf).toPandas(), duck.execute(plans.SQL[name]).df())


@pytest.mark.parametrize("name", ["r5_propagation_rerank", "r6_cluster_first"])
def test_rankings_are_whole(spark, sf, name):
    df = plans.QUERIES[name](spark, sf).toPandas()
    assert (df.groupby("src").size() == 10).all() and (df.src != df.dst).all() and not df.duplicated(["src", "dst"]).any()
