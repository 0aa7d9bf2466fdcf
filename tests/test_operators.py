"""Small cases computed by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import columns as c
from tessera.operators import graph, metrics, profile, rerank, signal, vectors


@pytest.mark.parametrize("scores, want", [([(1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1)], 0.0), ([(1, 0.9), (1, 0.2), (0, 0.8), (0, 0.1)], 0.5)])
def test_equal_error_rate(spark, scores, want):
    curve = metrics.operating_points(spark.createDataFrame(scores, "label int, score double"))
    assert metrics.eer(curve).first().eer == want and metrics.min_dcf(curve).first().min_dcf == want


def test_cosine_order_and_zero_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.src, r.rank): (r.dst, round(r.score, 6)) for r in vectors.knn(df, 2).collect()}
    assert got[0, 1] == (1, 0.707107)
    v = df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    pairs = spark.createDataFrame([(0, 1), (0, 3), (0, 9)], "left_id long, right_id long")
    assert {r.right_id: r.score is None for r in vectors.pair_scores(pairs, v).collect()} == {1: False, 3: True, 9: True}


def test_chunk_starts(spark):
    at = lambda n: spark.range(1).select(signal.chunk_starts(F.lit(n), 4, 3)).first()[0]
    assert at(10) == [0, 3, 6] and at(9) == [0, 3, 5]


def test_entropy(spark):
    got = spark.range(1).select(c.normalised_entropy(F.array(*map(F.lit, (0.98, 0.01, 0.01)))), c.normalised_entropy(F.array(*map(F.lit, (1 / 3,) * 3)))).first()
    assert got[0] < 0.15 and got[1] == pytest.approx(1.0)


def test_gini(spark):
    for values, want in (([0, 0, 0, 4], 0.75), ([1, 1, 1, 1], 0.0), ([0, 0], 0.0)):
        assert metrics.gini(spark.createDataFrame([(v,) for v in values], "x long"), "x").first()[0] == pytest.approx(want)


def plain_propagation(n: int, edges: list, iterations: int) -> list:
    """Sequential propagation in place: ascending rows, largest sum, ties to the smallest label."""
    label = list(range(n))
    for _ in range(iterations):
        before = list(label)
        for i in range(n):
            score: dict = {}
            for a, b, w in edges:
                if a == i:
                    score[label[b]] = score.get(label[b], 0) + w
            if score:
                label[i] = min(score, key=lambda x: (-score[x], x))
        if label == before:
            break
    return label


def test_label_propagation(spark):
    import random

    rng = random.Random(8)
    edges = [(a, b, rng.randint(1, 4) / 4) for a in range(25) for b in rng.sample(range(25), 3) if a != b]
    nodes = spark.range(25).withColumnRenamed("id", "id")
    got = graph.label_propagation(nodes, spark.createDataFrame([(a, b, 1, w) for a, b, w in edges], "src long, dst long, rank int, weight double"), 5)
    names = {r.id: r.label for r in got.collect()}
    want = plain_propagation(25, edges, 5)
    order = {x: i for i, x in enumerate(sorted(set(want)))}
    assert [names[i] for i in range(25)] == [order[x] for x in want]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 9)], "a long, b long")
    from tessera.operators.components import components

    assert {r.id: r.component_id for r in components(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}


def test_score_blocks_hold_every_pair(spark):
    rows = [(i, [float(i % 7) - 3, float(i % 5), 1.0]) for i in range(60)] + [(60, [0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(r.left_id, r.right_id): r.score for r in vectors.score_blocks(v.where("id % 20 = 0"), v, block=7).collect()}
    want = {(r.left_id, r.right_id): r.score for r in vectors.score_table(v.where("id % 20 = 0"), v).collect() if r.left_id != r.right_id}
    assert got.keys() == want.keys() and len(got) == 4 * 60
    assert all((got[p] is None) == (want[p] is None) and (got[p] is None or abs(got[p] - want[p]) < 1e-12) for p in want)


def test_numbered_over_several_ranges(spark):
    rows = [(i, None if i % 11 == 0 else float(i * 37 % 13)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, x double").repartition(5)
    order = [F.desc_nulls_first("x"), F.asc("id")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.id: r.at for r in profile.numbered(df, order, "at").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0.0), r[0]))
    assert got == {i: at for at, (i, _) in enumerate(want, 1)}


def test_whole_tables_are_registered(spark, sf):
    from tessera import plans

    n = lambda t: spark.read.parquet(f"{sf}/{t}.parquet").count()
    part = lambda t, key, m: spark.read.parquet(f"{sf}/{t}.parquet").where(f"{key} % {m} = 0").count()
    assert plans.QUERIES["t1_sort_all"](spark, sf).count() == n("customer")
    assert plans.QUERIES["x5_score_matrix_all"](spark, sf).count() == part("embeddings", "vec_id", 50) * (n("embeddings") - 1)
    assert plans.QUERIES["j9_enrol_test_all"](spark, sf).count() == part("supplier", "s_suppkey", 10) * (n("supplier") - 1)


@pytest.mark.parametrize("most", [8, 600])
def test_class_first_with_backfill(spark, most):
    """Against a plain loop over rows, where few neighbours fit and buckets are larger and smaller than the bound."""
    import numpy as np

    rng = np.random.default_rng(9)
    e = rng.normal(0, 1, (48, 6))
    e /= np.sqrt((e * e).sum(axis=1, keepdims=True))
    v = spark.createDataFrame([(i, e[i].tolist(), i % 12) for i in range(48)], "id long, v array<double>, label long").cache()
    classes = vectors.class_posteriors(v, "label", 5).cache()
    knn = vectors.knn(v.select(F.col("id").alias("vec_id"), F.col("v").alias("embedding")), 12).where("rank <= 4 or src % 2 = 0").cache()
    p = rerank.ClassFirst(k=9, most=most)
    got = {}
    for r in rerank.class_first(knn, classes, v, p).orderBy("src", "rank").collect():
        got.setdefault(r.src, []).append((r.dst, round(r.score, 9)))
    near, prob = {}, {}
    for r in knn.orderBy("src", "rank").collect():
        near.setdefault(r.src, []).append((r.dst, r.score))
    for r in classes.orderBy("id", "class_rank").collect():
        prob.setdefault(r.id, {})[r.class_id] = r.prob
    first = {i: next(iter(x)) for i, x in prob.items()}
    filled = trimmed = 0
    for i in range(48):
        mine, rank = list(prob[i])[:3], {j: n for n, (j, _) in enumerate(near[i], 1)}
        chosen = [j for j, _ in near[i] if first[j] in mine]
        if len(chosen) < p.least:
            filled += 1
            for c in mine:
                bucket = sorted((j for j in range(48) if first[j] == c), key=lambda j: (-prob[j][c], j))[:most]
                chosen += [j for j in bucket if j != i and j not in chosen]
                if len(chosen) >= most:
                    break
            if len(chosen) > most:
                trimmed += 1
                chosen = sorted(chosen, key=lambda j: -(e[i] @ e[j]))[:most]
        score = {j: 0.5 * e[i] @ e[j] + 0.35 * sum(q * prob[j].get(c, 0) for c, q in prob[i].items()) + 0.15 * (first[i] == first[j]) + (0.03 / rank[j] if j in rank else 0) for j in chosen}
        best = sorted(score, key=lambda j: -score[j]) if len(chosen) >= p.least else []
        want = ([(j, score[j]) for j in best] + [(j, s) for j, s in near[i] if j not in best])[: p.k]
        assert [j for j, _ in got[i]] == [j for j, _ in want], i
        assert np.allclose([s for _, s in got[i]], [s for _, s in want])
    assert filled and (trimmed or most == 600)
    plain = rerank.class_first(knn, classes, v, rerank.ClassFirst(k=9, most=most, backfill=False))
    assert plain.count() < sum(len(x) for x in got.values())


def test_class_first_is_registered_with_backfill(spark, sf):
    from tessera import plans

    df = plans.QUERIES["r9_class_first_backfill"](spark, sf).toPandas()
    assert (df.groupby("src").size() == 10).all() and (df.src != df.dst).all() and not df.duplicated(["src", "dst"]).any()
