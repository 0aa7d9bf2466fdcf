from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm.common import cut
from tessera.llm.mixing import hypergeometric, in_shards, mix_sources, splitting_tree, unit
from tests.llm.fixtures import awkward, nothing


def plain_targets(sizes: dict, weights=(3, 1, 2), share=1.5, most=2.0) -> dict:
    """Reshare the excess by weight until no target is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, full, rest = {s: 0.0 for s in order}, set(), share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        left = rest - sum(most * sizes[s] for s in full)
        for s in free:
            target[s] = left * weight[s] / sum(weight[x] for x in free)
        over = [s for s in free if target[s] > most * sizes[s] + 1e-9]
        if not over or not free:
            break
        full |= set(over)
        target |= {s: most * sizes[s] for s in over}
    return target


def check(df, rows):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in df.collect():
        sizes[r.source] += words(r.text)
    want, taken, counts = plain_targets(sizes), Counter(), df.groupBy("source").count().count()
    assert len(rows) == df.count() and counts == len(sizes)
    for r in rows:
        s = r.row.source
        assert r.size == words(r.row.text) and r.source_size == sizes[s] and 0 <= r.taken <= 2 * r.size
        assert r.target == pytest.approx(want[s])
        assert r.taken == sum(d.words for d in r.draws)
        taken[s] += r.taken
    for s, n in taken.items():
        n_docs = sum(1 for r in rows if r.row.source == s)
        assert abs(n - want[s]) <= max(1, n_docs)  # each document rounds its part
    return taken


def test_tables(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mix_sources(df).collect()
    check(df, rows)
    assert sorted((r.id, r.taken) for r in rows) == sorted((r.id, r.taken) for r in mix_sources(df.repartition(7)).collect())


def test_awkward_rows(spark):
    df = awkward(spark)
    check(df, mix_sources(df).collect())
    assert mix_sources(nothing(spark)).count() == 0


def test_one_source_and_hot_source(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("w w w").alias("text"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"))
    check(df, mix_sources(df).collect())
    one = df.withColumn("source", F.lit("x"))
    assert check(one, mix_sources(one).collect())["x"] == 9000


def test_tree_loses_nothing(spark):
    quotas = spark.createDataFrame([(i, n) for i, n in enumerate((1, 0, 7, 1000, 64, 333), 1)], "source_no int, quota long")
    leaves = splitting_tree(quotas, 4, 5).collect()
    total, shard = Counter(), Counter()
    for r in leaves:
        assert r.quota >= 0
        total[r.source_no] += r.quota
        shard[r.shard] += r.quota
    assert total == Counter({1: 1, 3: 7, 4: 1000, 5: 64, 6: 333})
    assert len(shard) == 16 and max(shard.values()) - min(shard.values()) <= 1


def test_hypergeometric(spark):
    """Mean and spread of draws of 30 from 100 with 40 marked."""
    u = unit(F.col("id"))
    got = [r[0] for r in spark.range(4000).select(hypergeometric(F.lit(30), F.lit(40), F.lit(100), u)).collect()]
    mean = sum(got) / len(got)
    var = sum((x - mean) ** 2 for x in got) / len(got)
    assert mean == pytest.approx(12, abs=0.2) and var == pytest.approx(30 * 0.4 * 0.6 * 70 / 99, rel=0.1)
    edge = spark.range(50).select(hypergeometric(F.lit(90), F.lit(40), F.lit(100), u).alias("k")).agg(F.min("k"), F.max("k")).first()
    assert edge[0] >= 30 and edge[1] <= 40


def test_shards_are_disjoint(spark, sf):
    rows = mix_sources(spark.read.parquet(f"{sf}/documents.parquet")).select("id", F.explode("draws").alias("d")).collect()
    seen = defaultdict(set)
    for r in rows:
        assert r.d.copy not in seen[r.id]
        seen[r.id].add(r.d.copy)
    assert len({r.d.shard for r in rows}) == 8


def test_many_sources_without_a_broadcast(spark, sf):
    """Beyond broadcast_rows sources the plan meets the rows by source and block; the result does not change."""
    df = spark.read.parquet(f"{sf}/documents.parquet")
    take = lambda **k: sorted((r.id, r.taken, r.target, str(r.draws)) for r in mix_sources(df, **k).collect())
    assert take() == take(broadcast_rows=3)


def test_whole_documents_in_shuffled_shards(spark, sf):
    """Each shard is one run of rows in the order of its positions; sources come near their targets in whole documents."""
    df = spark.read.parquet(f"{sf}/documents.parquet")
    mixed = mix_sources(df)
    rows = in_shards(mixed).collect()
    assert all(a.position <= b.position for a, b in zip(rows, rows[1:], strict=False) if a.shard == b.shard)
    assert len([1 for a, b in zip(rows, rows[1:], strict=False) if a.shard != b.shard]) == len({r.shard for r in rows}) - 1
    taken = {r.id: r.taken / r.size for r in mixed.where("size > 0").collect()}
    n = Counter(r.row.doc_id for r in rows)
    assert all(abs(n[i] - x) < 1 + 1e-9 or n[i] <= 2 for i, x in taken.items()) and set(n) <= set(taken)
    words, want = Counter(), {r.source: r.target for r in mixed.select("row.source", "target").distinct().collect()}
    size = {r.id: (r.row.source, r.size) for r in mixed.collect()}
    for i, c in n.items():
        words[size[i][0]] += c * size[i][1]
    largest = Counter()
    for s, m in size.values():
        largest[s] = max(largest[s], m)
    assert all(abs(words[s] - t) <= 3 * (t * largest[s]) ** 0.5 + 3 * largest[s] for s, t in want.items())


def test_awkward_rows_in_shards(spark):
    rows = in_shards(mix_sources(awkward(spark))).collect()
    assert rows and in_shards(mix_sources(nothing(spark))).count() == 0


def test_native(spark, sf):
    plan = mix_sources(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert cut(spark.range(3)).count() == 3


def test_many_small_sources_meet_their_targets(spark):
    """20,000 sources, hundreds of which hold one-word texts in a single block: each comes within two words or 1 % of its target."""
    tiny = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("w").alias("text"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("source"))
    small = spark.range(60_000).select((F.col("id") + 1_000_000).alias("doc_id"), F.lit("w").alias("text"), F.concat(F.lit("s"), (F.col("id") % 60).cast("string")).alias("source"))
    got = mix_sources(tiny.unionByName(small), blocks=8).groupBy("row.source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count("*").alias("n")).toPandas()
    assert len(got) == 20_060
    many = got[got.n > 1]
    assert (got.taken - got.target).abs()[got.n == 1].max() <= 1
    fine = mix_sources(small).groupBy("row.source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).toPandas()
    assert ((fine.taken - fine.target).abs() <= (fine.target * 0.01).clip(lower=2)).all()
    assert ((many.taken - many.target).abs() / many.target).mean() < 0.05


def test_parts_of_a_draw(spark):
    """Over many nodes, the parts that sources have in halves have the mean and the spread of a multivariate hypergeometric draw."""
    quotas = [40, 10, 25, 5, 20, 60, 3, 37, 50]
    left = [{r.source_no: r.quota for r in splitting_tree(spark.createDataFrame(list(enumerate(quotas, 1)), "source_no int, quota long"), 1, seed).collect() if r.shard == 0} for seed in range(12)]
    total = sum(quotas)
    for no, q in enumerate(quotas, 1):
        mean = sum(x.get(no, 0) for x in left) / len(left)
        sd = (total / 2 * (q / total) * (1 - q / total) * (total / 2) / (total - 1)) ** 0.5
        assert abs(mean - q / 2) <= 5 * sd / len(left) ** 0.5 + 1e-9
