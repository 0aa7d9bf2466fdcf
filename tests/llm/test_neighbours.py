from __future__ import annotations

import math

import numpy as np
import pytest

from tessera.llm.neighbours import MultiIndex, near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v int"


def plain(rows: list, least: float = 0.98) -> dict:
    unit = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(np.array(v, np.float32), float)
        unit[i] = (label, x / np.linalg.norm(x))
    part, links = {i: i for i, *_ in rows}, dict.fromkeys((i for i, *_ in rows), 0)

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    ids = sorted(unit)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            (la, x), (lb, y) = unit[a], unit[b]
            if la == lb and len(x) == len(y) and x @ y >= least:
                links[a] += 1
                links[b] += 1
                p, q = sorted((root(a), root(b)))
                part[q] = p
    return {i: (links[i], root(i)) for i in part}


def made(n: int, dims: int = 16) -> list:
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, dims))
    rows = []
    for i in range(n):
        v = centres[rng.integers(12)] + rng.normal(size=dims) * rng.choice([0.0, 0.05, 0.2, 1.0])
        rows.append((i, [float(x) for x in v * rng.choice([0.01, 1, 100])], int(rng.integers(3)), "x", 1))
    rows += [(n, None, 1, "x", 1), (n + 1, [0.0] * dims, 1, "x", 1), (n + 2, [float("nan")] * dims, 1, "x", 1), (n + 3, [None] + [1.0] * (dims - 1), 1, "x", 1), (n + 4, [float("inf")] * dims, 1, "x", 1), (n + 5, rows[0][1], None, "x", 1), (n + 6, [1.0] * 5, 1, "x", 1), (n + 7, [1.0] * 5, 1, "x", 1), (n + 8, [], 1, "x", 1)]
    return rows


def compare(spark, rows, **kw):
    got = near_vectors(spark.createDataFrame(rows, SCHEMA), params=MultiIndex(**kw)).collect()
    want = plain(rows)
    assert len(got) == len(rows)
    assert {r.id: (r.n_links, r.component_id) for r in got} == want
    assert all(r.kept == (r.id == r.component_id) for r in got)


def test_all_links_are_found(spark):
    compare(spark, made(600), recall=1.0)


def test_small_blocks_and_codebooks(spark):
    """A hot cell is dealt to many blocks; links across blocks still count."""
    compare(spark, made(300), block=16, codes=2, sample=50, recall=1.0)


def test_lower_recall_visits_fewer_cells(spark):
    rows = made(400)
    want = sum(n for n, _ in plain(rows).values())
    got = near_vectors(spark.createDataFrame(rows, SCHEMA), params=MultiIndex(recall=0.6, block=32)).agg({"n_links": "sum"}).first()[0]
    assert 0.6 * want <= got <= want
    got = near_vectors(spark.createDataFrame(rows, SCHEMA), params=MultiIndex(block=32)).agg({"n_links": "sum"}).first()[0]
    assert 0.99 * want <= got <= want


def test_copies_count_as_rows(spark):
    """A hot vector: its copies link with each other and with what is near, as if all pairs were listed."""
    rows = [(i, [1.0, 0.0, 0.0, 0.0], 1, "x", 1) for i in range(50)] + [(100 + i, [1.0, 0.01 * i, 0.0, 0.0], 1, "x", 1) for i in range(8)] + [(200, [1.0, 0.0, 0.0, 0.0], 2, "x", 1)]
    compare(spark, rows)


def test_empty(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert near_vectors(spark.createDataFrame([(1, None, None, None, None)], SCHEMA)).collect()[0].n_links == 0


def planted(n: int, dims: int = 64) -> list:
    """Unit vectors of `dims` dimensions in one label, every third with a partner just inside the linking distance, in a random direction."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(n):
        x = rng.normal(size=dims)
        x /= np.linalg.norm(x)
        rows.append((2 * i, x.tolist(), 1, "x", 1))
        if i % 3 == 0:
            y = rng.normal(size=dims)
            y -= (y @ x) * x
            c = rng.uniform(0.9801, 0.985)
            rows.append((2 * i + 1, (c * x + math.sqrt(1 - c * c) * y / np.linalg.norm(y)).tolist(), 1, "x", 1))
    return rows


def test_recall_at_the_width_of_the_tables(spark):
    """Links close to the bound, 64 dimensions, 32 x 32 cells: the default finds 0.99 of brute force's links, recall 1 all."""
    rows = planted(2400)
    x = np.array([np.array(r[1], np.float32) for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = int((np.triu(x @ x.T, 1) >= 0.98).sum())
    assert want > 700
    df = spark.createDataFrame(rows, SCHEMA)
    for recall, least in ((0.9999, 0.99), (1.0, 1.0)):
        got = near_vectors(df, params=MultiIndex(recall=recall, block=16, codes=32)).agg({"n_links": "sum"}).first()[0] / 2
        assert least * want <= got <= want


def test_reach_halves_lose_nothing():
    """If both of a pair lie farther than the reach from the other's cell, they are too far apart to link."""
    p = MultiIndex(recall=1.0)
    assert p.reach(64) == pytest.approx(0.02) and MultiIndex().reach(64) < p.reach(64)


def test_repeated_ids_and_clashing_names(spark):
    rows = [(1, [1.0, 0.0], 1, 5, 6, 7), (1, [1.0, 0.0], 1, 5, 6, 7), (2, [1.0, 0.01], 1, 5, 6, 7), (3, [0.0, 1.0], 1, 5, 6, 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, cell int, x int, w int")
    got = sorted((r.id, r.n_links, r.component_id) for r in near_vectors(df).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]
    wide = spark.createDataFrame([(1, [1e200, 0.0], 1), (2, [1e200, 1e198], 1)], "vec_id long, embedding array<double>, label int")
    assert {r.n_links for r in near_vectors(wide).collect()} == {1}
