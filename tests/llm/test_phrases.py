"""Mined phrases against counts of every phrase."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import phrases, queries
from tests.llm.fixtures import awkward, nothing

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=10, best=2000, cover=50):
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(SMALL)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for m in (1, 2, 3):
                f[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    want = []
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        inside = {q for p, v in c.items() if len(p) == 3 and v >= least for q in (p[:2], p[1:]) if 100 * v >= cover * c[q]}
        out = []
        for p, a in c.items():
            if len(p) > 1 and a >= least and p not in inside:
                score, at = min((1_000_000 * a * a // (c[p[:i]] * c[p[i:]]), i) for i in range(1, len(p)))
                out.append((score, a, " ".join(p), c[p[:at]], c[p[at:]]))
        out.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        want += [(lang, i + 1, p, a, left, right, n, score) for i, (score, a, p, left, right) in enumerate(out[:best])]
    return sorted(want)


def got(df, **kw):
    return sorted(map(tuple, phrases.collocations(df, **kw).collect()))


def test_shipped_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain([(r.lang, r.text) for r in docs.collect()])
    assert len(want) > 50 and sorted(map(tuple, queries.op12_phrase_mining(spark, sf).collect())) == want


@pytest.mark.parametrize("bits", [0, 2, 20])
def test_random_words(spark, bits):
    """Few words, so that phrases repeat, overlap and tie; with tables of one and four cells most words share theirs."""
    rng = np.random.default_rng(5)
    words = ["a", "b", "A", "c", "été", "漢", "dd", "e'", "-"]
    rows = [(("en", "fr", None)[i % 3], "".join(str(rng.choice(words)) + str(rng.choice([" ", "  ", "\t", ", ", "\n", " . "], p=[0.6, 0.1, 0.1, 0.1, 0.05, 0.05])) for _ in range(int(rng.integers(0, 60))))) for i in range(90)]
    df = spark.createDataFrame(rows, "lang string, text string")
    for kw in ({}, {"least": 2, "best": 20}, {"least": 3, "cover": 90}):
        assert got(df, bits=bits, **kw) == plain(rows, **kw)


def test_parts_of_a_language(spark):
    """Ranks taken over parts of a language first are those over all of it."""
    rng = np.random.default_rng(6)
    rows = [("en", " ".join(f"w{x}" for x in rng.integers(0, 12, 80))) for _ in range(30)]
    df = spark.createDataFrame(rows, "lang string, text string")
    scored = phrases.collocations(df, least=2, best=10_000).drop("rank")
    a = sorted((r.rank, r.phrase) for r in phrases.ranked(scored, 25, 1_000_000).collect())
    assert a == [(x[1], x[2]) for x in plain(rows, least=2, best=25)]


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = [(r.lang, r.text) for r in df.collect()]
    assert got(df, least=2) == plain(rows, least=2) and len(plain(rows, least=2)) > 0
    assert got(nothing(spark)) == [] and got(df.where("text is null")) == [] and got(df, least=10**6) == []


def test_fragments_hold_each_phrase_once():
    """Every occurrence of a phrase of frequent words lies in the fragment of exactly one of its words."""
    rng = np.random.default_rng(7)
    text = " ".join(rng.choice(["x", "y", "z", "x x"], 200))
    words = phrases.Words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    names = dict(zip(words.hash.view(np.int64).tolist(), text.split(" "), strict=True))
    found = Counter()
    for r in phrases.fragments(words, "en", np.full((2, 4), 5)).to_pylist():
        row = [names.get(r[c]) for c in phrases.PLACES]
        for a, b in ((1, 3), (2, 4), (0, 3), (1, 4), (2, 5)):
            if None not in row[a:b]:
                found[" ".join(row[a:b])] += r["count_all"]
    all_words = text.split(" ")
    assert found == Counter(" ".join(all_words[i : i + m]) for m in (2, 3) for i in range(len(all_words) - m + 1))


def test_shared_hashes(spark, monkeypatch):
    """Where two words share a hash, all hashes are taken anew."""
    rows = [("en", "a b c a b c a b d")] * 5
    texts = spark.createDataFrame(rows, "lang string, text string")
    seen = []
    count = phrases.word_counts

    def first_clashes(df, seed):
        seen.append(seed)
        out = count(df, seed)
        return out.withColumn("x", F.lit(7).cast("long")) if seed == 0 else out

    monkeypatch.setattr(phrases, "word_counts", first_clashes)
    assert got(texts, least=2) == plain(rows, least=2) and seen == [0, 1]
