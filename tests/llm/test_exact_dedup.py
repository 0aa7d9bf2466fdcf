from __future__ import annotations

import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.llm.exact_dedup import exact_dedup
from tests.llm.fixtures import awkward, nothing


def plain(rows: list) -> dict:
    """(id, digest) to (keep_id, size), by brute force."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", text or "").encode()).hexdigest()].append((-len(text or ""), i is None, i or 0, i))
    return {(g[3], d): (min(own)[3], len(own)) for d, own in groups.items() for g in own}


def test_awkward_rows(spark):
    df = awkward(spark)
    got = exact_dedup(df).select("row.doc_id", "row.row", "keep_id", "group_size", "kept", "text_sha256").collect()
    want = plain([(r.doc_id, r.text) for r in df.collect()])
    assert len(got) == df.count()
    for r in got:
        assert (r.keep_id, r.group_size) == want[r.doc_id, r.text_sha256]
        assert r.kept == (r.doc_id == r.keep_id)


def test_narrow_filter_gives_the_same(spark, sf):
    """With hardly any bits nearly all rows shuffle; the result does not change."""
    df = spark.read.parquet(f"{sf}/documents.parquet")
    take = lambda **k: sorted(exact_dedup(df, **k).select("row.doc_id", "keep_id", "group_size").collect())
    assert take() == take(max_bits=64)


def test_native_and_empty(spark, sf):
    assert exact_dedup(nothing(spark)).count() == 0
    plan = exact_dedup(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_hot_group(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same text")).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    got = exact_dedup(df)
    assert got.where("kept").count() == 2001 and got.where("group_size = 1000 and keep_id = 0").count() == 1000
