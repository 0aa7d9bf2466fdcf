from __future__ import annotations

import random

import pytest
import sentencepiece

from tessera.llm import pieces
from tests.llm.fixtures import awkward, nothing


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_same_ids_as_the_library(spark, sf, library):
    for r in pieces.encode(spark.read.parquet(f"{sf}/documents.parquet")).select("row.text", "ids").collect():
        assert list(r.ids) == library.encode(r.text)


def test_random_texts(library):
    t, rng = pieces.Transducer(pieces.model_bytes()), random.Random(6)
    letters = ["a", "e", "the", "ing", " ", "  ", "\n", "\t", "é", "漢", "🙂", "0", "12", ".", "-", "Z", "­", "ß", "▁"]
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))
        ids = t.encode([text])[0]
        assert ids == library.encode(text), repr(text)
        assert t.decode(ids) == text.replace("▁", " ")


def test_long_runs(library):
    t = pieces.Transducer(pieces.model_bytes())
    for text in (" " * 1000, "a" * 3000, "ab " * 1000, "\n" * 500, "=" * 777):
        assert t.encode([text])[0] == library.encode(text)


def test_awkward_rows(spark):
    df = awkward(spark)
    encoded = pieces.encode(df)
    back = pieces.decode(encoded.select("row.doc_id", "ids")).select("row.doc_id", "text").collect()
    want = {r.doc_id: r.text or "" for r in df.collect() if r.doc_id is not None}
    assert len(back) == df.count() and all(r.text == want[r.doc_id] for r in back if r.doc_id is not None)
    assert pieces.encode(nothing(spark)).count() == 0 and pieces.digests(nothing(spark)).count() == 0
    assert all(r.round_trip for r in pieces.digests(df).collect())


def test_blocks_of_any_size(library):
    """Texts longer than a block are cut into chunks, and several short ones share one; the ids are the same."""
    t = pieces.Transducer(pieces.model_bytes(), room=20)
    texts = [f"word{i} other{i % 7}  thing\n" * (1 + i % 5) for i in range(100)] + ["", None, "   ", " a " * 300, "x" * 200 + " y"]
    want = [library.encode(x or "") for x in texts]
    for block in (1, 50, 1000, 1 << 19):
        t.block = block
        assert t.encode(texts) == want


def test_long_words_and_short_ones_by_the_same_arcs(library):
    """Words beyond `wide` characters are composed one at a time, the others together; both as the library does."""
    t, rng = pieces.Transducer(pieces.model_bytes()), random.Random(8)
    words = ["".join(rng.choice(["an", "ing", "x", "é", "漢", "🙂", "7", "-", "st"]) for _ in range(rng.randint(1, 50))) for _ in range(400)]
    assert any(len(w) > t.wide for w in words) and any(len(w) < t.wide for w in words)
    want = [library.encode(w) for w in words]
    assert t.encode(words) == want
    for wide in (0, 10_000):
        other = type("Other", (pieces.Transducer,), {"wide": wide})(pieces.model_bytes())
        assert other.encode(words) == want


def test_pairs_fit_as_single_merges_say():
    t, rng = pieces.Transducer(pieces.model_bytes()), random.Random(9)
    names = {i: p for p, i in t.ids.items()}
    some = rng.sample(sorted(names), 3000)
    x, y = pieces.np.array(some[:1500]), pieces.np.array(some[1500:])
    want = [t.merged(names[a] + names[b]) == [names[a], names[b]] for a, b in zip(x.tolist(), y.tolist(), strict=True)]
    for _ in range(2):  # computed, then from the table
        assert t.pairs_fit(x, y).tolist() == want


def test_lookup_with_keys_that_share_slots():
    rng = pieces.np.random.default_rng(1)
    keys = rng.permutation(1 << 14)[:5000].astype(pieces.np.int64) << 40
    table = pieces.Lookup(keys[:4000], pieces.np.arange(4000))
    assert table.get(keys[:4000]).tolist() == list(range(4000))
    assert set(table.get(keys[4000:]).tolist()) == {-1}
    assert pieces.Lookup(keys[:0], keys[:0]).get(keys).tolist() == [-1] * 5000
