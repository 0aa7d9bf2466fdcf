"""Expressions that lambdas name are computed once for a row, not once for each element."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import signal
from tessera.plans import QUERIES


@pytest.mark.parametrize("operator", [signal.downmixed, lambda c: signal.loaded(c, 1, 40, -20.0, 12.0), signal.mean_normalised])
def test_rows_are_computed_once(spark, operator):
    rows = np.random.default_rng(5).normal(size=(3, 50)).clip(-1, 1)
    df = spark.createDataFrame([(rows.tolist(),)], "c array<array<double>>").select(operator(F.reverse("c")).alias("y"))
    assert df._jdf.queryExecution().analyzed().toString().count("reverse(") == 1
    got = np.array(df.first().y)
    if got.ndim == 2:
        assert np.allclose(got, (rows - rows.mean(axis=0))[::-1])
    elif len(got) == 50:
        assert np.allclose(got, rows.mean(axis=0))
    else:
        mono = rows.mean(axis=0)[1:41]
        gain = min(max(-20 - 20 * np.log10(np.sqrt(np.mean(mono**2))), -12), 12, -1 - 20 * np.log10(np.abs(mono).max()))
        assert np.allclose(got, mono * 10 ** (gain / 20))


@pytest.mark.parametrize("name", ["q9_mean_normalised", "q13_loaded"])
def test_signals_are_computed_once(spark, sf, name):
    assert QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("SIN(") == 1
