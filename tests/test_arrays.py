"""Matrices as .npy files: round trips, partitions by rows, byte ranges, faults."""

from __future__ import annotations

import glob
import json
import os

import numpy as np
import pytest

from tessera.sources import arrays


def test_files_of_numpy(spark, tmp_path):
    """What NumPy writes is read in runs of rows, whatever the type; vectors are one column; the row number goes on from file to file."""
    arrays.register(spark)
    a, b = np.arange(60, dtype=np.float32).reshape(20, 3), np.arange(9, dtype=np.float32).reshape(3, 3) - 5
    np.save(tmp_path / "a.npy", a)
    np.save(tmp_path / "b.npy", b)
    df = spark.read.format("npy").option("rows", 7).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 4 and df.schema.simpleString() == "struct<row:bigint,values:array<float>>"
    got = {r.row: r["values"] for r in df.collect()}
    assert got == {i: row.tolist() for i, row in enumerate(np.concatenate([a, b]))}
    for dtype in ("<f8", "<i4", "<i8", "<f2"):
        np.save(tmp_path / "one.npy", np.arange(4).astype(dtype))
        assert [list(r["values"]) for r in spark.read.format("npy").load(f"file:{tmp_path}/one.npy").orderBy("row").collect()] == [[0], [1], [2], [3]]
    for wrong in (np.asfortranarray(a), np.zeros((2, 2, 2)), np.array(["x"])):
        np.save(tmp_path / "wrong.npy", wrong)
        with pytest.raises(Exception, match="C order"):
            spark.read.format("npy").load(str(tmp_path / "wrong.npy")).count()
    os.remove(tmp_path / "wrong.npy")
    with pytest.raises(Exception, match="widths or types"):
        spark.read.format("npy").load(str(tmp_path)).count()


def test_round_trip(spark, tmp_path):
    """A bank keeps rows and metadata in line; files stay within their number of rows, and NumPy reads them."""
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(size=5).tolist(), f"n{i}") for i in rng.permutation(200)]
    df = spark.createDataFrame(rows, "id long, v array<double>, name string").repartition(6)
    arrays.write_bank(df, str(tmp_path), "id", "v", "<f8")
    got = arrays.read_bank(spark, str(tmp_path)).orderBy("row").collect()
    assert [(r.id, list(r["values"]), r.name) for r in got] == sorted((i, v, n) for i, v, n in rows) and [r.row for r in got] == list(range(200))
    names = json.load(open(f"{tmp_path}/matrix/_index.json"))["files"]
    whole = np.concatenate([np.load(f"{tmp_path}/matrix/{n}") for n in names])
    assert np.array_equal(whole, np.array([v for _, v, _ in sorted(rows)]))
    df.select("v").write.format("npy").mode("append").options(path=f"{tmp_path}/matrix", dtype="<f8", rows=16).save()
    assert spark.read.format("npy").load(f"{tmp_path}/matrix").count() == 400 and max(len(np.load(f)) for f in glob.glob(f"{tmp_path}/matrix/*.npy")) <= 200
    df.limit(3).select("v").write.format("npy").mode("overwrite").options(path=f"{tmp_path}/matrix", column="v").save()
    assert spark.read.format("npy").load(f"{tmp_path}/matrix").count() == 3 and len(glob.glob(f"{tmp_path}/matrix/*.npy")) <= 3


def test_failed_writes_leave_no_rows(spark, tmp_path):
    arrays.register(spark)
    good = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    good.write.format("npy").mode("overwrite").options(path=f"{tmp_path}/m").save()
    for rows in ([([1.0],), ([1.0, 2.0],)], [([1.0, None],)], [(None,)]):
        bad = spark.createDataFrame(rows, "v array<double>").repartition(1)
        with pytest.raises(Exception, match="width|null"):
            bad.write.format("npy").mode("append").options(path=f"{tmp_path}/m").save()
    assert spark.read.format("npy").load(f"{tmp_path}/m").count() == 1
    with pytest.raises(Exception, match="array column"):
        spark.range(3).write.format("npy").mode("overwrite").options(path=f"{tmp_path}/x").save()


def test_pack(spark, tmp_path):
    """Frames of many rows in one matrix; single rows come back from their own bytes, across files too; empty and null rows have none."""
    rng = np.random.default_rng(2)
    frames = {i: rng.integers(0, 100, (int(rng.integers(0, 9)), 3)).astype(float).tolist() for i in range(30)}
    rows = [*frames.items(), (90, []), (91, None)]
    df = spark.createDataFrame(rows, "id long, f array<array<double>>").repartition(5)
    arrays.write_pack(df, str(tmp_path), "id", "f")
    want = {**frames, 90: [], 91: []}
    assert {r.id: r.frames for r in arrays.read_pack(spark, str(tmp_path)).collect()} == want
    some = spark.createDataFrame([(3,), (17,), (91,), (12345,)], "id long")
    assert {r.id: r.frames for r in arrays.read_pack(spark, str(tmp_path), some).collect()} == {i: want[i] for i in (3, 17, 91)}
    places = {r["id"]: (r["first"], r["count"]) for r in spark.read.parquet(f"{tmp_path}/places.parquet").collect()}
    assert [places[i][0] for i in sorted(want)] == np.concatenate([[0], np.cumsum([len(want[i]) for i in sorted(want)])[:-1]]).tolist()


def test_reads_only_its_bytes(tmp_path):
    """Rows are read though all other bytes of the file are missing."""
    x = np.arange(4000, dtype=np.float32).reshape(1000, 4)
    np.save(tmp_path / "a.npy", x)
    m = arrays.header(str(tmp_path / "a.npy"))
    os.truncate(tmp_path / "a.npy", m.offset + 20 * m.row_bytes)
    assert np.array_equal(arrays.read_rows(m, 5, 15), x[5:20])
    with pytest.raises(ValueError, match="not all there"):
        arrays.read_rows(m, 15, 10)


def test_files_follow_the_order_of_many_ranges(spark, tmp_path):
    """Ranges that stay apart (no coalescing) lie in the matrix in order of their rows, in banks and in packs."""
    from pyspark.sql import functions as F

    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = spark.range(400).select((F.col("id") * 7 % 400).alias("id")).withColumn("v", F.array(F.col("id").cast("float"), (F.col("id") * 2).cast("float")))
        arrays.write_bank(df, f"{tmp_path}/bank", "id", "v")
        got = arrays.read_bank(spark, f"{tmp_path}/bank").collect()
        assert len(got) == 400 and all(list(r["values"]) == [r.id, 2 * r.id] and r.row == r.id for r in got)
        arrays.write_pack(df.withColumn("f", F.array("v", "v")), f"{tmp_path}/pack", "id", "f")
        got = arrays.read_pack(spark, f"{tmp_path}/pack").collect()
        assert len(got) == 400 and all([list(f) for f in r.frames] == [[r.id, 2 * r.id]] * 2 for r in got)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
