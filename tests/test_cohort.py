"""The cohort bank's faults and its fallback; its rows and summary are compared with SQL."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.cohort import Selection, build_bank
from tessera.sources import arrays


def parts(spark, bad=False):
    meta = spark.createDataFrame([(i, f"o{i % 3}", "train") for i in range(9)], "id long, owner string, split string")
    v = spark.createDataFrame([(i, [0.0, 0.0] if bad and i == 4 else [3.0 + i, 4.0]) for i in range(9)], "id long, v array<double>")
    return meta, v, spark.createDataFrame([("1",), ("2",)], "key string"), spark.createDataFrame([("o9",)], "owner string")


def build(spark, path, selection, bad=False, taken=None, seen=None):
    meta, v, trials, validation = parts(spark, bad)
    return build_bank(meta, v, path, "id", "owner", F.array(F.col("id").cast("string")), taken if taken is not None else trials, seen if seen is not None else validation, selection).first().asDict()


def test_bank(spark, tmp_path):
    got = build(spark, str(tmp_path), Selection({"split": ["TRAIN"]}, least=2, most=2, total=5))
    rows = arrays.read_bank(spark, str(tmp_path)).orderBy("place").collect()
    assert [(r.id, r.owner) for r in rows] == [(0, "o0"), (4, "o1"), (5, "o2"), (3, "o0"), (7, "o1")]
    assert all(np.linalg.norm(r["values"]) == pytest.approx(1, abs=1e-6) for r in rows)
    assert (got["after_trials"], got["excluded_by_most"], got["excluded_by_total"], got["selected_owners"], got["width"], got["fallback_used"]) == (7, 1, 1, 3, 2, False)


def test_faults_and_fallback(spark, tmp_path):
    everyone = spark.createDataFrame([(str(i),) for i in range(9)], "key string")
    with pytest.raises(ValueError, match="no rows"):
        build(spark, f"{tmp_path}/a", Selection(), taken=everyone)
    assert build(spark, f"{tmp_path}/b", Selection(fallback=True), taken=everyone)["fallback_used"]
    with pytest.raises(ValueError, match="o1"):
        build(spark, f"{tmp_path}/c", Selection(), seen=spark.createDataFrame([("o1",)], "owner string"))
    with pytest.raises(ValueError, match="direction"):
        build(spark, f"{tmp_path}/d", Selection(), bad=True)
