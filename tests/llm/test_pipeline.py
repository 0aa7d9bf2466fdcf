from __future__ import annotations

from collections import Counter

import pytest
import sentencepiece

import corpus_pipeline
from tessera.llm import pieces
from tessera.llm.common import read, table
from tests.llm.fixtures import awkward
from tests.llm.test_exact_dedup import plain as plain_copies
from tests.llm.test_minhash import plain as plain_near


@pytest.fixture(scope="module")
def stages(spark, sf):
    """The documents before the first stage and after each."""
    out = [read(spark, sf, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(table(stage(spark, out[-1], sf)))
    return out


def test_columns(stages):
    for docs in stages[1:-1]:
        assert docs.schema.names == stages[0].schema.names
    assert stages[-1].schema.names == ["doc_id", "source", "n_tokens", "ids"]


def test_toxic_documents_go(spark, sf, stages):
    labels = {r.doc_id: r.toxic for r in read(spark, sf, "labels").collect()}
    before, after = ({r.doc_id for r in d.collect()} for d in stages[:2])
    toxic, clean = ({i for i in before if labels.get(i) == v} for v in (1, 0))
    assert len(toxic & after) <= 0.2 * len(toxic) and len(clean & after) >= 0.97 * len(clean)


def test_one_of_each_set_of_copies(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert {r.doc_id for r in stages[2].collect()} == {v[0] for v in plain_copies(rows).values()}


def test_one_of_each_near_group(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    assert {r.doc_id for r in stages[3].collect()} == {c for _, c in plain_near(rows, 5).values()}


def test_mix_takes_no_document_more_than_twice(stages):
    n = Counter(r.doc_id for r in stages[4].collect())
    assert set(n) <= {r.doc_id for r in stages[3].collect()} and max(n.values()) <= 2


def test_ids(stages):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == stages[4].count()
    for r in rows:
        assert list(r.ids) == sp.encode(texts[r.doc_id]) and r.n_tokens == len(r.ids)


def test_stages_without_documents(spark, sf, stages):
    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_stages_on_awkward_rows(spark, sf):
    """Nulls, empty and long texts, repeated rows and clashing names: each stage keeps the columns and its rule."""
    docs = awkward(spark)
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        rows = out.collect()
        if name == "sentencepiece":
            assert out.schema.names == ["doc_id", "source", "n_tokens", "ids"] and len(rows) == n and all(r.n_tokens == len(r.ids) for r in rows)
        else:
            assert out.schema.names == docs.schema.names
        if name == "exact_dedup":
            assert sorted(r.text for r in rows if r.text and r.doc_id in (10, 11)) == ["a"]
        if name == "minhash_near_dedup":
            assert sum(r.text is None for r in rows) >= 1 and len([r for r in rows if r.doc_id in (7, 8)]) == 1
        if name == "mixing":
            assert all(r.text and r.text.strip() for r in rows)
