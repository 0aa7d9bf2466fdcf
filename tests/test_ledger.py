"""Work over conditions that is stopped and begun again."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.sources import ledger

KEYS = ["model", "condition"]
SCHEMA = "model string, condition string, total long"


def plan(spark, models=("a", "b", "01"), conditions=("clean", "noise/5", "x y"), rows=3):
    return spark.createDataFrame([(m, c, i) for m in models for c in conditions for i in range(rows)], "model string, condition string, v long")


def test_only_the_rest_is_done(spark, tmp_path):
    """Stopped after one part, then after a crash between results and ledger, then run to its end: each key is finished once."""
    path, seen = str(tmp_path), []

    def work(rows):
        own = sorted(map(tuple, rows.select(*KEYS).distinct().collect()))
        seen.append(own)
        return rows.groupBy(*KEYS).agg(F.sum("v").alias("total"))

    p = plan(spark)
    assert ledger.finished(spark, path) is None and ledger.run_pending(p, path, KEYS, work, most=1) == 1
    first = {tuple(r) for r in ledger.finished(spark, path).select(*KEYS).collect()}
    assert first == set(seen[0]) and 0 < len(first) < 9

    def broken(rows):
        work(rows)
        return rows.groupBy(*KEYS).agg(F.raise_error(F.lit("stopped")).cast("long").alias("total"))

    with pytest.raises(Exception, match="stopped"):
        ledger.run_pending(p, path, KEYS, broken)
    assert {tuple(r) for r in ledger.finished(spark, path).select(*KEYS).collect()} == first
    # A crash after the results of some keys were written: they are there, but not finished.
    spark.createDataFrame([("a", "clean", 99), ("a", "noise/5", 99), ("a", "x y", 99), ("b", "clean", 99)], SCHEMA).join(spark.createDataFrame(sorted(first), "model string, condition string"), KEYS, "left_anti").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(f"{path}/results.parquet")
    assert {(r.model, r.condition) for r in ledger.finished_results(spark, path, SCHEMA, KEYS).collect()} == first
    seen.clear()
    ledger.run_pending(p, path, KEYS, work)
    assert set(sum(seen, [])) == {tuple(r) for r in p.select(*KEYS).distinct().collect()} - first and len(sum(seen, [])) == 9 - len(first)
    got = sorted(map(tuple, ledger.finished_results(spark, path, SCHEMA, KEYS).select("model", "condition", "total").collect()))
    assert got == sorted((m, c, 3) for m in ("a", "b", "01") for c in ("clean", "noise/5", "x y"))
    assert {r["rows"] for r in ledger.finished(spark, path).collect()} == {1} and ledger.run_pending(p, path, KEYS, work) == 0


def test_more_work_and_empty_results(spark, tmp_path):
    """A plan that has grown does only what is new; keys without results are finished too."""
    path = str(tmp_path)
    some = lambda rows: rows.where("condition <> 'none'").groupBy(*KEYS).agg(F.sum("v").alias("total"))
    ledger.run_pending(plan(spark, conditions=("clean",)), path, KEYS, some, steps=2)
    ledger.run_pending(plan(spark, conditions=("clean", "none", "late")), path, KEYS, some, steps=3)
    assert sorted((r.condition, r["rows"]) for r in ledger.finished(spark, path).collect()) == [("clean", 1)] * 3 + [("late", 1)] * 3 + [("none", 0)] * 3
    assert ledger.finished_results(spark, path, SCHEMA, KEYS).count() == 6 and ledger.pending(plan(spark, conditions=("none",)), path, KEYS).count() == 0
