"""Label propagation in ascending order of rows: joins over the edge table against a loop."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.operators import graph


def loop(nodes, edges, iterations, self_weight=0.0, penalty=0.0):
    """Dense labels after passes over all rows in order."""
    label = {i: i for i in nodes}
    near: dict[int, list] = {}
    for src, dst, _, w in sorted(edges, key=lambda e: (e[0], e[2])):
        near.setdefault(src, []).append((dst, w))
    for _ in range(iterations):
        count, changed = {}, False
        for x in label.values():
            count[x] = count.get(x, 0) + 1
        for i in sorted(near):
            total = {label[i]: self_weight} if self_weight > 0 else {}
            for j, w in near[i]:
                total[label[j]] = total.get(label[j], 0.0) + w
            best = max(total, key=lambda x: (total[x] / count.get(x, 0 or 1) ** penalty if penalty else total[x], -x))
            changed |= best != label[i]
            label[i] = best
        if not changed:
            break
    names = {x: n for n, x in enumerate(sorted(set(label.values())))}
    return {i: names[x] for i, x in label.items()}


def giant(n, degree, seed, ties):
    rng = np.random.default_rng(seed)
    edges = []
    for i in range(n):
        others = [j for j in rng.choice(n, degree + 1, replace=False).tolist() if j != i][:degree]
        others = list(dict.fromkeys([*others[:-1], (i + 1) % n]))
        edges += [(i * 3, j * 3, r + 1, float(rng.choice([0.25, 0.5, 1.0]) if ties else rng.random())) for r, j in enumerate(o for o in others if o != i)]
    return [i * 3 for i in range(n)] + [1, 5, 1_000_000], edges


@pytest.mark.parametrize("seed, ties, self_weight, penalty", [(2, True, 0.0, 0.0), (4, False, 0.3, 0.5)])
def test_one_component_by_joins(spark, seed, ties, self_weight, penalty):
    """All rows in one component, which no group may hold: the labels are those of the loop, and of the groups."""
    ids, edges = giant(24, 3, seed, ties)
    nodes, e = spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(edges, "src long, dst long, rank int, weight double")
    want = loop(ids, edges, 2, self_weight, penalty)
    assert len(set(want.values())) > 3
    for most in (0, 10**6):
        assert {r.id: r.label for r in graph.label_propagation(nodes, e, 2, self_weight, penalty, most_edges=most).collect()} == want


def test_large_and_small_components(spark):
    ids, edges = giant(14, 3, 5, True)
    more = [(1001 + i, 1001 + (i + 1) % 3, 1, 1.0) for i in range(3)]
    nodes, e = spark.createDataFrame([(i,) for i in [*ids, 1001, 1002, 1003]], "id long"), spark.createDataFrame(edges + more, "src long, dst long, rank int, weight double")
    want = loop([*ids, 1001, 1002, 1003], edges + more, 2)
    assert {r.id: r.label for r in graph.label_propagation(nodes, e, 2, most_edges=20).collect()} == want


def test_plan_of_a_pass(spark):
    """A pass is joins and aggregations: no Python, no window, no exchange of all rows into one partition."""
    ids, edges = giant(8, 2, 6, False)
    labels, e = spark.createDataFrame([(i, i) for i in ids], "id long, label long"), spark.createDataFrame(edges, "src long, dst long, rank int, weight double")
    seen = []
    real, graph.cut = graph.cut, lambda df: (seen.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1]
    try:
        graph.relaxed_pass(labels, e).count()
    finally:
        graph.cut = real
    assert len(seen) >= 3 and not any(x in p for p in seen for x in ("Python", "Pandas", "Arrow", "SinglePartition", "Window"))


def test_rounds_are_bounded_by_blocks(spark):
    """A path numbered in order, whose labels run along all of it in one pass: as many rounds as blocks and passes at most, not as rows."""
    n = 60
    edges = [(i, i - 1, 1, 1.0) for i in range(1, n)] + [(0, 1, 1, 0.5)]
    nodes, e = spark.createDataFrame([(i,) for i in range(n)], "id long"), spark.createDataFrame(edges, "src long, dst long, rank int, weight double")
    seen, real = [], graph.cut
    graph.cut = lambda df: (seen.append(1), real(df))[1]
    try:
        got = {r.id: r.label for r in graph.label_propagation(nodes, e, 2, most_edges=20).collect()}
    finally:
        graph.cut = real
    assert got == loop(list(range(n)), edges, 2) and len(seen) <= 3 + 3 * (3 + 2)


def test_rounds_write_no_tables(spark):
    """Twelve blocks whose labels run through all of them: a round is one job over the blocks' partitions, however many rounds there are."""
    n = 60
    edges = [(i, i - 1, 1, 1.0) for i in range(1, n)] + [(0, 1, 1, 0.5)] + [(i, (i * 7 + 3) % n, 2, 0.75) for i in range(n) if (i * 7 + 3) % n != i]
    nodes, e = spark.createDataFrame([(i,) for i in range(n)], "id long"), spark.createDataFrame(edges, "src long, dst long, rank int, weight double")
    seen, real = [], graph.cut
    graph.cut = lambda df: (seen.append(1), real(df))[1]
    try:
        got = {r.id: r.label for r in graph.label_propagation(nodes, e, 3, 0.5, most_edges=10).collect()}
    finally:
        graph.cut = real
    assert got == loop(list(range(n)), edges, 3, 0.5) and len(seen) <= 5
