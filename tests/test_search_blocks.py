"""The search and the score table: one side held in blocks, the other streamed past them."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.operators import vectors


def table(spark, n=90, seed=4):
    e = np.random.default_rng(seed).normal(size=(n, 5)).round(1)
    e[n // 2 :] = e[: n - n // 2]  # equal scores
    return e / np.linalg.norm(e, axis=1, keepdims=True), spark.createDataFrame([(i * 3, x.tolist()) for i, x in enumerate(e)], "id long, v array<double>")


@pytest.mark.parametrize("k", [1, 7, 200])
def test_best_of_many_blocks(spark, k):
    """The gallery comes in pieces smaller than a block and than k: the best are those of the whole, the smaller id first."""
    e, df = table(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    try:
        got = {}
        for r in vectors.knn(df, k, id_col="id", vector_col="v", block=16).orderBy("src", "rank").collect():
            got.setdefault(r.src, []).append((r.rank, r.dst, r.score))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(e)
    for i, x in enumerate(e):
        s = {j * 3: float(x @ y) for j, y in enumerate(e) if j != i}
        near = got[i * 3]
        assert [r for r, _, _ in near] == list(range(1, min(k, len(s)) + 1)) and [z for _, _, z in near] == pytest.approx(sorted(s.values(), reverse=True)[:k])
        assert all(abs(s[j] - z) < 1e-9 for _, j, z in near) and len({j for _, j, _ in near}) == len(near)
        assert all(a < b for (_, a, y), (_, b, z) in zip(near, near[1:]) if y == z)


def test_no_candidates_are_shuffled(spark):
    """Vectors are shuffled once; the candidates of each pair of blocks were shuffled too, and grow with the square of the rows."""
    plan = vectors.knn(table(spark)[1], 5, id_col="id", vector_col="v", block=16)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan


def test_scores_hold_the_gallery_once(spark):
    """How many rows are multiplied at a time does not say how often they are shuffled: every 50th row was, once for each piece of the gallery."""
    e, df = table(spark)
    found = vectors.score_blocks(df.where("id % 2 = 0"), df, block=4)
    assert found.rdd.getNumPartitions() == 1 and found.count() == 45 * 89
    got = {(r.left_id, r.right_id): r.score for r in found.collect()}
    assert all(abs(z - e[a // 3] @ e[b // 3]) < 1e-9 for (a, b), z in got.items())


def test_pairs_shuffle_a_row_65_times_at_most(spark):
    """Blocks grow with an owner: by blocks of 4, each of 2,000 rows was shuffled 501 times."""
    from tessera.operators import skew

    rows = spark.range(2000).selectExpr("id as k", "'a' as owner")
    for owner in (None, "owner"):
        seen = []
        real, skew.within_blocks = skew.within_blocks, lambda *a: seen.append(real(*a)) or seen[-1]
        try:
            found = skew.unordered(rows, owner, "k", 4)
        finally:
            skew.within_blocks = real
        dealt = seen[0][0]
        assert dealt.count() <= 64 * 2000 and found.selectExpr("count(distinct left, right)", "count(*)", "count_if(left >= right)").first()[:] == (1999000, 1999000, 0)
