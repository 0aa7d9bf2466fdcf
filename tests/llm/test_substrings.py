from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from tessera.llm.substrings import Repeats, remove_repeats
from tests.llm.fixtures import awkward, nothing


def plain(rows: list, length: int) -> dict:
    """id to (n_bytes, n_removed, n_spans, sha256), from a table of all strings."""
    seen, out = set(), {}
    for i, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for a in range(len(data) - length + 1):
            s = data[a : a + length]
            if s in seen:
                gone[a : a + length] = b"\x01" * length
            else:
                seen.add(s)
        runs = sum(1 for a in range(len(gone)) if gone[a] and (a == 0 or not gone[a - 1]))
        out[i, hashlib.sha256(data).hexdigest()] = (len(data), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(data, gone, strict=True) if not g)).hexdigest())
    return out


def compare(spark, rows: list, **kw):
    p = Repeats(**kw)
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), params=p).collect()
    want = plain(rows, p.length)
    by_id = {k[0]: v for k, v in want.items()}
    assert sorted(r.id or -1 for r in got) == sorted(i or -1 for i, _ in rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == by_id[r.id], r.id


def test_tables(spark, sf):
    compare(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


@pytest.mark.parametrize("hot", [2, 20_000])
def test_small_alphabet(spark, hot):
    """Strings of few letters repeat everywhere: many ties, overlaps and hot anchors."""
    rng = random.Random(hot)
    rows = [(i, "".join(rng.choice("ab" if i % 2 else "abc ") for _ in range(rng.randint(0, 150)))) for i in range(150)]
    rows += [(1000, "a" * 300), (1001, "ab" * 200), (1002, None), (None, "ab" * 30), (1003, "é" * 100)]
    compare(spark, rows, length=12, gram=4, hot=hot)


def test_hot_passage(spark):
    """One line in all texts, beside other copies and own words."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(5000)]
    line = "this licence line is in every text of the table and goes on for somewhat more than one hundred bytes, so it goes."
    rows = [(i, " ".join(rng.sample(words, 30)) + " " + line * (1 + i % 3) + " " + " ".join(rng.sample(words, 10))) for i in range(120)]
    compare(spark, rows, hot=16)


def test_awkward_rows(spark):
    df = awkward(spark).where("doc_id is not null or text is not null")
    compare(spark, [(r.doc_id, r.text) for r in df.collect()])
    assert remove_repeats(df).count() == df.count() and remove_repeats(nothing(spark)).count() == 0


def test_removed_runs(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(400))
    r = {x.id: x for x in remove_repeats(spark.createDataFrame([(1, text), (2, "@@" + text[:150] + "@@")], "doc_id long, text string")).collect()}
    assert [(x.start, x.stop) for x in r[2].removed] == [(2, 152)]


def test_long_text_in_stretches(spark, monkeypatch):
    """A text that is longer than a stretch: repeats across and within stretches."""
    import tessera.llm.substrings as module

    rng = random.Random(9)
    part = "".join(rng.choice("abcdefgh ") for _ in range(700))
    text = "".join(rng.choice("abcdefgh ") for _ in range(1500)) + part + "x" * 50 + part
    monkeypatch.setattr(module, "PIECE", 256)
    p = module.Repeats()
    own, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    runs = list(module.stretches(offsets, p))
    assert runs[0][1] == 0 and runs[-1][2] == len(text) and all(b[1] == a[2] - p.length + 1 for a, b in zip(runs, runs[1:], strict=False))
    whole = set()
    for h, _, a, s, e in [module.anchors(own, offsets, p)]:
        for i in range(len(h)):
            whole |= {(int(h[i]), int(a[i]), x) for x in range(int(s[i]), int(e[i]) + 1)}
    parts = set()
    for _, low, high, starts in runs:
        h, _, a, s, e = module.anchors(own[low:high], starts, p)
        for i in range(len(h)):
            parts |= {(int(h[i]), int(a[i]) + low, x + low) for x in range(int(s[i]), int(e[i]) + 1)}
    assert parts == whole
