"""Balanced batches: permutations, shares, distinct owners, fair use of rows, and resumption at any batch."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import batches
from tessera.operators.batches import Progress


def table(spark, sizes, external=()):
    rows = [(f"o{o}", o * 1000 + i, o in external) for o, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame([*rows, (None, 1, False), ("o0", None, False)], "owner string, key long, far boolean")
    return batches.balanced(df, "owner", "key", F.col("far") & (F.col("key") % 2 == 0)), rows


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97])
def test_permutation(spark, n):
    orders = []
    for key in (1, 2, 12_345):
        got = spark.range(n).select(batches.shuffled(F.col("id"), F.lit(n), F.lit(key)).alias("x")).collect()
        orders.append([r.x for r in got])
        assert sorted(orders[-1]) == list(range(n))
    assert n < 10 or len({tuple(o) for o in orders}) == 3


def test_places_are_spread(spark):
    """Over many keys each place goes everywhere about equally often."""
    got = spark.range(5000).select(batches.shuffled(F.lit(3), F.lit(5), F.col("id") * 17 + 1).alias("x")).groupBy("x").count().collect()
    assert len(got) == 5 and all(850 <= r["count"] <= 1150 for r in got)


def test_epochs(spark):
    t, rows = table(spark, [1, 2, 3, 5, 8, 30])
    assert t.total == len(rows) and t.sizes == {0: 6}
    seen = []
    for epoch in (0, 1):
        got = batches.batches(t, 4, 9, epoch, 0, 30).collect()
        assert len(got) == 120 and {(r.batch, r.slot) for r in got} == {(b, s) for b in range(30) for s in range(4)}
        by = defaultdict(list)
        for r in got:
            by[r.batch].append(r.owner)
            assert r.key // 1000 == int(r.owner[1:]) and 2 <= r.crop_seconds <= 4
        assert all(len(set(o)) == 4 for o in by.values()) and len({(r.batch, r.crop_seconds) for r in got}) == 30
        uses = Counter(r.owner for r in got)
        assert max(uses.values()) - min(uses.values()) <= 1
        keys = Counter(r.key for r in got)
        for o, n in enumerate([1, 2, 3, 5, 8, 30]):
            own = [keys[o * 1000 + i] for i in range(n)]
            assert max(own) - min(own) <= 1, o
        seen.append([r.key for r in sorted(got, key=lambda r: (r.batch, r.slot))])
    assert seen[0] != seen[1]


def test_more_slots_than_owners(spark):
    t, _ = table(spark, [2, 2])
    got = batches.batches(t, 5, 1, 0, 0, 2).groupBy("owner").count().collect()
    assert sorted(r["count"] for r in got) == [5, 5]


def test_domain_share(spark):
    t, _ = table(spark, [3, 4, 5, 2, 6], external={1, 3})
    assert t.sizes == {0: 3, 1: 2}
    got = batches.batches(t, 8, 3, 0, 0, 12, share=0.3).collect()
    assert Counter((r.batch, r.domain) for r in got) == {(b, d): (6, 2)[d] for b in range(12) for d in (0, 1)}
    assert {r.owner for r in got if r.domain} == {"o1", "o3"}
    assert [batches.external_slots(8, s) for s in (None, 0.0, 0.01, 0.5, 0.99, 1.0)] == [0, 0, 1, 4, 7, 8]
    with pytest.raises(ValueError):
        batches.batches(table(spark, [3])[0], 4, 3, 0, 0, 1, share=0.5)
    with pytest.raises(ValueError):
        batches.external_slots(4, 1.5)


def test_resumed_runs_agree(spark):
    """Whatever the stops, across epochs too: the same batches as one run."""
    t, _ = table(spark, [3, 1, 4, 2, 7])
    order = lambda df: sorted(map(tuple, df.collect()))
    whole, end = batches.taken(t, 4, 5, Progress(), 11)
    assert end == Progress(2, 1)
    state, parts = Progress().state(), []
    for n in (0, 1, 3, 2, 5):
        part, after = batches.taken(t, 4, 5, Progress(**state), n)
        parts += order(part)
        state = after.state()
    assert sorted(parts) == order(whole) and len(parts) == 44 and Progress(**state) == end
    with pytest.raises(ValueError):
        Progress(0, 9).take(1, 5)


def test_plan_reads_only_the_batches(spark):
    """No sort of the table and no window when batches are drawn: a range of slots and two joins."""
    t, _ = table(spark, [3, 4])
    plan = batches.batches(t, 4, 5, 0, 100, 101)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "rangepartitioning" not in plan and "Python" not in plan


def test_key_is_computed_once_for_a_row(spark):
    """The rounds name the key as a column; the places are those of the interpreted function."""
    df = spark.range(300).select("id", (F.col("id") % 7 + 40).alias("n"))
    args = (F.col("id") % F.col("n"), F.col("n"), batches.key_of(7, 0, F.col("id") % 3))
    seen, real = [], batches.cut
    batches.cut = lambda d: (seen.append(d._jdf.queryExecution().optimizedPlan().toString()), real(d))[1]
    try:
        got = batches.with_shuffled(df, "at", *args).collect()
    finally:
        batches.cut = real
    assert {r.id: r.at for r in got} == {r.id: r.at for r in df.select("id", batches.shuffled(*args).alias("at")).collect()}
    assert seen[0].count("sha2(") == 1 and "lambda" not in seen[0]
