"""Queries that SQL cannot express, against plain loops over the same neighbour table, and operators that need files or signals."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import plans
from tessera.operators.filterbank import FilterBank, log_mel
from tessera.operators import rerank, reports, select, signal
from tessera.plans import base
from tessera.plans import reports as report_plans
from tessera.sources import readers


@pytest.fixture(scope="module")
def near(spark, sf):
    """src to its neighbours (dst, score) in order of rank."""
    out = defaultdict(list)
    for r in base.knn(spark, sf, 60).orderBy("src", "rank").collect():
        out[r.src].append((r.dst, r.score))
    return out


def mutual(near, edge_top, back_top):
    back = {(d, s) for s, row in near.items() for d, _ in row[:back_top]}
    return {s: [(d, w) for d, w in row[:edge_top] if (s, d) in back] for s, row in near.items()}


def propagated(edges, ids, iterations):
    """Sequential passes in ascending order; the greatest weight wins, then the smaller label."""
    label = {i: i for i in ids}
    for _ in range(iterations):
        changed = False
        for i in sorted(ids):
            total = defaultdict(float)
            for j, w in edges.get(i, []):
                total[label[j]] += w
            if total:
                best = max(total, key=lambda x: (total[x], -x))
                changed |= best != label[i]
                label[i] = best
        if not changed:
            break
    return label


def dense(label):
    names = {v: n for n, v in enumerate(sorted(set(label.values())))}
    return {i: names[v] for i, v in label.items()}


def components(ids, pairs):
    part = {i: i for i in ids}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        part[y] = x
    return {i: root(i) for i in ids}


def test_label_propagation(spark, sf, near):
    got = {r.id: r.label for r in plans.QUERIES["g7_label_propagation"](spark, sf).collect()}
    assert got == dense(propagated(mutual(near, 10, 20), list(near), 5))


def test_split_oversized(spark, sf, near):
    edges = mutual(near, 10, 20)
    label = dense(propagated(edges, list(near), 5))
    rank = {(s, d): n for s, row in near.items() for n, (d, _) in enumerate(row, 1)}
    big = {v for v, n in Counter(label.values()).items() if n > 20}
    parts = components([i for i in near if label[i] in big], [(s, d) for s, row in edges.items() for d, _ in row if label[s] == label[d] and label[s] in big and rank[s, d] <= 3])
    want = dense({i: (label[i], parts[i] if label[i] in big else -1) for i in near})
    assert {r.id: r.label for r in plans.QUERIES["g8_split_oversized"](spark, sf).collect()} == want


def adjusted(near, rank_top, back_top=20):
    mean = {s: sum(w for _, w in row[:20]) / len(row[:20]) for s, row in near.items()}
    values = np.array(list(mean.values()))
    z = {s: (m - values.mean()) / max(values.std(), 1e-6) for s, m in mean.items()}
    back = {(d, s) for s, row in near.items() for d, _ in row[:back_top]}
    order = lambda s, d, w: (-round(w + 0.03 * ((s, d) in back) - 0.02 * z[d], 12), d)
    return {s: [d for d, _ in sorted(row[:rank_top], key=lambda x: order(s, *x))] for s, row in near.items()}  # noqa: B023


def preferred(ranking, label, sizes, least, k=10):
    size, out = Counter(label.values()), {}
    for s, row in ranking.items():
        same = [d for d in row if label[d] == label[s]]
        usable = sizes[0] <= size[label[s]] <= sizes[1] and len(same) >= least
        out[s] = ((same + [d for d in row if label[d] != label[s]]) if usable else row)[:k]
    return out


def rows_of(df):
    out = defaultdict(list)
    for r in df.orderBy("src", "rank").collect():
        out[r.src].append(r.dst)
    return dict(out)


def test_propagation_rerank(spark, sf, near):
    label = propagated(mutual(near, 10, 20), list(near), 5)
    assert rows_of(plans.QUERIES["r5_propagation_rerank"](spark, sf)) == preferred(adjusted(near, 60), label, (5, 120), 3)


def test_community_rerank(spark, sf, near):
    edges = mutual(near, 10, 20)
    label = components(list(near), [(s, d) for s, row in edges.items() for d, _ in row])
    got = rerank.community_rerank(base.knn(spark, sf, 60), base.nodes(spark, sf), rank_top=60, sizes=(2, 400), least_candidates=1)
    assert rows_of(got) == preferred(adjusted(near, 60), label, (2, 400), 1)


def test_teacher_dropout(spark, sf):
    main, labels, variants = report_plans.dropout(spark, sf)
    near, own = rows_of(main.where("rank <= 10")), {r.id: r.label for r in labels.collect()}
    others = [{r.id: r.label for r in v.collect()} for v in variants]
    want = {}
    for s, row in near.items():
        shares = []
        for other in others:
            a, b = {d for d in row if own[d] == own[s]}, {d for d in row if other[d] == other[s]}
            shares.append(len(a & b) / len(a | b) if a | b else 1.0)
        want[s] = sum(shares) / len(shares)
    got = {r.src: r.stability for r in reports.stability(main, labels, variants, 10).collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 for s in want)


def test_routed_graph(spark, sf):
    rows = plans.QUERIES["r14_router_graph"](spark, sf).collect()
    assert len(rows) == 500 and {r.policy for r in rows} <= {"classaware_c4", "soup_c4", "exact", "weak_c4", "reciprocal_only", "full_c4"}


def test_filter_bank(spark):
    """A tone falls into the band around its frequency; frames and bands are counted."""
    rate, n = 8000, 4000
    tone = lambda hz: [float(np.sin(2 * np.pi * hz * i / rate)) for i in range(n)]
    df = spark.createDataFrame([(1, tone(300)), (2, tone(2500)), (3, [])], "id long, x array<double>").select("id", log_mel(FilterBank(rate=rate, bands=20, fft=256, pad_end=False))("x").alias("m"))
    m = {r.id: np.array(r.m) for r in df.collect()}
    assert m[1].shape == m[2].shape == ((n - 200) // 80 + 1, 20) and len(m[3]) == 0
    assert m[1].mean(axis=0).argmax() < m[2].mean(axis=0).argmax()


def test_trimmed_signal(spark):
    rate = 1000
    x = [0.0] * 1000 + [0.5, -0.5] * 1500 + [0.0] * 1000
    short = [0.0] * 1000 + [0.5, -0.5] * 100 + [0.0] * 1000
    out = [r.y for r in spark.createDataFrame([(0, x), (1, short), (2, [0.1])], "i int, x array<double>").select("i", signal.trimmed(rate)("x").alias("y")).orderBy("i").collect()]
    assert 3000 <= len(out[0]) <= 3000 + 2 * 190 and len(out[1]) == len(short) and out[2] == [0.1]


def test_numpy_files(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6.0).reshape(3, 2))
    np.savez(tmp_path / "b.npz", embeddings=np.ones((2, 2)), names=np.array(["x", "y"]))
    got = readers.numpy_matrix(spark, str(tmp_path), ids="names").orderBy("file", "row").collect()
    assert [(r.id, list(r.v)) for r in got] == [("0", [0.0, 1.0]), ("1", [2.0, 3.0]), ("2", [4.0, 5.0]), ("x", [1.0, 1.0]), ("y", [1.0, 1.0])]
    np.save(tmp_path / "bad.npy", np.arange(3.0))
    with pytest.raises(Exception, match="non-empty matrix"):
        readers.numpy_matrix(spark, str(tmp_path / "bad.npy")).collect()


def test_strict_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": \n')
    assert readers.json_lines(spark, str(tmp_path / "x.jsonl"), "a long", strict=False).where("a is null").count() == 1
    with pytest.raises(ValueError, match="1 unreadable of 2"):
        readers.json_lines(spark, str(tmp_path / "x.jsonl"), "a long")


def test_running_sums_over_ranges(spark):
    from tessera.operators.profile import running_sums

    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("o"), (F.col("id") % 5).alias("x")).repartition(6)
    rows = running_sums(df, [F.asc("o")], {"upto": "x"}).orderBy("o").collect()
    earlier = running_sums(df, [F.asc("o")], {"before": "x"}, earlier=True).orderBy("o").collect()
    total = 0
    for a, b in zip(rows, earlier, strict=True):
        assert b.before == total
        total += a.x
        assert a.upto == total


def test_pairs_beyond_the_broadcast(spark):
    from tessera.operators.vectors import every_pair

    a, b = spark.range(40).withColumnRenamed("id", "x"), spark.range(30).withColumnRenamed("id", "y")
    assert {tuple(r) for r in every_pair(a, b, "x", most=3, block=7).collect()} == {(i, j) for i in range(40) for j in range(30)}


def test_soft_label_kernel(spark):
    fused = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.4), (1, 4, 0.1)], "src long, dst long, score double")
    labels = spark.createDataFrame([(2, 7), (3, 8), (4, 7)], "id long, label int")
    got = {r.label: r.prob for r in select.soft_labels(fused, labels, 2).collect()}
    assert got[7] == pytest.approx(1 / (1 + np.exp(-2.0))) and sum(got.values()) == pytest.approx(1)


def test_wilcoxon_notes(spark):
    same = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "a double, b double")
    assert reports.signed_ranks(same, "a", "b").first().note == "all_zero_deltas"
    assert reports.signed_ranks(spark.createDataFrame([(1.0, 3.0)], "a double, b double"), "a", "b").first().note == "insufficient_overlap_for_wilcoxon"
    assert reports.two_sided(1.959964) == pytest.approx(0.05, abs=1e-5)


def test_platt_scaling(spark, sf):
    """The fitted slope and offset make the gradient of the logistic loss vanish (but for the ridge on the step)."""
    from tessera.operators import metrics
    from tessera.plans.evaluation import trials

    t = trials(spark, sf)
    a, b = metrics.platt(t)
    rows = t.collect()
    x, y = np.array([r.score for r in rows]), np.array([r.label for r in rows])
    e = y - 1 / (1 + np.exp(-(a * x + b)))
    assert abs(e.mean()) < 1e-6 and abs((e * x).mean()) < 1e-6
    row = plans.QUERIES["m15_platt"](spark, sf).first()
    assert row.slope == pytest.approx(a, abs=1e-6) and row.offset == pytest.approx(b, abs=1e-6)


def test_teacher_confidence(spark):
    """Four shares with their weights; a row that one table lacks counts as 0 there."""
    of = lambda *v: spark.createDataFrame(list(enumerate(v)), "src long, value double")
    got = {r.src: r.confidence for r in reports.teacher_confidence(of(1.0, 0.5), of(1.0, 0.0), of(1.0, 0.5), of(1.0)).collect()}
    assert got[0] == pytest.approx(1.0) and got[1] == pytest.approx(0.2 + 0.1)
