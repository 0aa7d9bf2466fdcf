"""Soft labels over kept clusters against plain dictionaries, and the whole chain's invariants."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera import plans
from tessera.operators import select


def test_kept_and_renormalised(spark):
    rng = np.random.default_rng(8)
    label = {i: int(rng.choice([0, 1, 2, 3], p=[0.5, 0.25, 0.2, 0.05])) for i in range(80)}
    fused = [(i, int(j), float(rng.random())) for i in range(80) for j in rng.choice(80, 6, replace=False) if i != j]
    sure = {i: float(rng.random()) for i in range(72)}
    sizes = Counter(label.values())
    kept = {x for x, n in sizes.items() if 3 <= n <= 30}
    assert 0 < len(kept) < len(sizes)
    soft = defaultdict(lambda: defaultdict(float))
    for i, j, s in fused:
        soft[i][label[j]] += s
    want = {}
    for i, by in soft.items():
        best = sorted(by, key=lambda x: (-round(by[x], 12), x))[:3]
        e = {x: np.exp((by[x] - by[best[0]]) / 0.1) for x in best}
        stay = [x for x in best if x in kept]
        if label[i] in kept and sure.get(i, 0) >= 0.3 and stay:
            want[i] = [(x, e[x] / sum(e[y] for y in stay)) for x in stay]
    labels = spark.createDataFrame(list(label.items()), "id long, label long")
    own = select.soft_labels(spark.createDataFrame(fused, "src long, dst long, score double"), labels, 3)
    got = defaultdict(list)
    for r in select.kept_soft_labels(own, labels, spark.createDataFrame(list(sure.items()), "src long, confidence double"), (3, 30), 0.3).orderBy("src", "place").collect():
        got[r.src].append((r.label, r.prob))
        assert r.place == len(got[r.src]) and r.confidence == sure[r.src]
    assert set(got) == set(want) and len(want) > 5
    for i, rows in want.items():
        assert [x for x, _ in got[i]] == [x for x, _ in rows] and [p for _, p in got[i]] == pytest.approx([p for _, p in rows])


def test_chain(spark, sf):
    rows = plans.QUERIES["l4_soft_labels"](spark, sf).toPandas()
    total = rows.groupby("src").prob.sum()
    assert len(total) > 50 and np.allclose(total, 1, atol=1e-5) and (rows.confidence >= 0.3).all()
    assert (rows.groupby("src").place.max() <= 5).all() and rows.prob.between(0, 1).all() and not rows.duplicated(["src", "label"]).any()


def test_variants_are_fused_and_grouped_together(spark):
    from pyspark.sql import functions as F

    from tessera.operators import graph, reports, rerank

    rng = np.random.default_rng(5)
    tables = []
    for _ in range(3):
        rows = [(i, int(j), r, 1.0 - 0.1 * r + float(rng.uniform(0, 0.01))) for i in range(40) for r, j in enumerate((i // 5 * 5 + x for x in rng.permutation(8)[:5] if i // 5 * 5 + x != i), 1)]
        tables.append(spark.createDataFrame(rows, "src long, dst long, rank int, score double").where("dst < 40"))
    nodes = spark.range(42)
    together = rerank.fuse_without([(t, 1.0) for t in tables], 5, 5).cache()
    labels = graph.variant_components(nodes, together, 4, 3).cache()
    packed, alone = labels.collect(), []
    for n in range(4):
        one = rerank.fuse_teachers([(t, 1.0) for at, t in enumerate(tables, 1) if at != n], 5, 5)
        rows = lambda df: sorted((r.src, r.dst, r.rank, round(r.score, 9), r.seen) for r in df.collect())
        assert rows(together.where(F.col("variant") == n)) == rows(one)
        near = {(r.src, r.dst) for r in one.where("rank <= 3").collect()}
        label = {i: i for i in range(42)}
        for _ in label:
            for a, b in near:
                if (b, a) in near:
                    label[a] = label[b] = min(label[a], label[b])
        assert {r.id: r.labels[n] for r in packed} == label
        alone.append(spark.createDataFrame(list(label.items()), "id long, label long"))
    main = together.where("variant = 0")
    each = {r.src: r.stability for r in reports.stability(main, alone[0], alone[1:], 5).collect()}
    assert {r.src: r.stability for r in reports.packed_stability(main, labels, 3, 5).collect()} == each and len(set(each.values())) > 1
