from __future__ import annotations

import random
import re
from itertools import combinations

import pytest

from tessera.llm.minhash import Near, drop_near, near_dedup
from tests.llm.fixtures import awkward, nothing


def plain(rows: list, words: int, percent: int = 80) -> dict:
    """id to (set size, component), from all pairs."""
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[a : a + words]) for a in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    part = {i: i for i in sets}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for a, b in combinations(sorted(i for i in sets if i is not None and sets[i]), 2):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            part[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def compare(spark, rows: list, **kw):
    p = Near(**kw)
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), params=p).collect()
    want = plain(rows, p.words)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.id], r.id
        assert r.kept == (r.id == r.component_id)


@pytest.mark.parametrize("words", [2, 5])
def test_tables(spark, sf, words):
    compare(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()], words=words)


def test_chains_and_groups(spark):
    """Chains of small changes, stars around one text, exact copies, and pairs close to the similarity on either side."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows, at = [], 0
    for _ in range(6):
        text = [rng.choice(words) for _ in range(60)]
        for _ in range(15):
            rows.append((at, " ".join(text)))
            at += 1
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(60)] = rng.choice(words)
    base = [rng.choice(words) for _ in range(100)]
    for n in range(1, 30):
        other = list(base)
        for i in rng.sample(range(100), n // 2):
            other[i] = "x" + str(rng.randrange(9999))
        rows.append((at, " ".join(other)))
        at += 1
    rng.shuffle(rows)
    compare(spark, rows, words=2)
    compare(spark, rows, words=2, block=8)


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = list({(r.doc_id, r.text) for r in df.collect() if r.doc_id is not None})
    compare(spark, rows, words=2)
    assert near_dedup(df).count() == df.count() and near_dedup(nothing(spark)).count() == 0


def test_drop_near_keeps_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(200))
    df = spark.createDataFrame([(1, text, "x"), (2, text + " more", "y"), (3, "other words", "z"), (4, None, "n")], "doc_id long, text string, id string")
    assert sorted(r.doc_id for r in drop_near(df).collect()) == [1, 3, 4]


def test_pruning_bound():
    """The fewest matches rise with the number of compared hashes, and no pair of similarity 0.8 is lost in expectation."""
    least = Near().least_matches()
    assert (least[1:] >= least[:-1]).all() and least[-1] < 0.8 * Near().hashes
