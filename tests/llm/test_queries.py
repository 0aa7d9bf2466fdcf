"""The queries themselves, over the shipped tables with planted cases, against SQL and brute force."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import sentencepiece

from tessera.llm import pieces, queries
from tests.llm.test_mixing import plain_targets
from tests.llm.test_secrets import plain as plain_secrets
from tests.test_plans import same_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The small tables with copies, near copies, nulls, empty texts, a shared passage, a secret and linked vectors beside them."""
    out = str(tmp_path_factory.mktemp("planted"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.orderBy("doc_id").first()
    words = first.text.split(" ")
    passage = "the shared passage of this test goes on for well over one hundred bytes so that every document that holds it has a repeat"
    more = [
        (100_001, first.text, "en", "src1", 1), (100_002, " ".join(words), "en", None, 1), (100_003, " ".join(words[:-1]) + " tail", "fr", "src1", 1), (100_004, None, "en", "src2", 0), (100_005, "", None, None, 0),
        (100_006, f"one {passage} two", "en", "src1", 1), (100_007, f"three {passage} four", "en", "src1", 1), (100_008, "password = abcdefgh12345678 é🙂 deadbeefdeadbeef00", "en", "src1", 1), (100_009, "  \t\n  ", "en", "src1", 5), (100_010, "a▁b " + " " * 3000, "en", "src1", 5),
    ]
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(f"{out}/documents.parquet")
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    base = [(r.vec_id, list(r.embedding), r.label) for r in vectors.orderBy("vec_id").limit(60).collect()]
    rng = np.random.default_rng(3)
    near = [(200_000 + i, [float(x) for x in np.array(v) * 3 + rng.normal(size=len(v)) * 0.01 * np.linalg.norm(v)], label) for i, (_, v, label) in enumerate(base)]
    odd = [(300_000, None, 1), (300_001, [0.0] * 64, 1), (300_002, base[0][1], None), (300_003, base[0][1], base[0][2]), (300_004, [float("nan")] * 64, 1)]
    vectors.unionByName(spark.createDataFrame(near + odd, vectors.schema)).write.parquet(f"{out}/embeddings.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{out}/labels.parquet")
    return out


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    same_rows(queries.QUERIES[name](spark, folder).toPandas(), con.execute(queries.SQL[name]).df())


def rows(spark, folder) -> dict:
    return {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def test_op3(spark, folder):
    """Every string of 100 bytes in one table."""
    docs = {i: (r.text or "").encode() for i, r in rows(spark, folder).items()}
    seen: set[bytes] = set()
    want = {}
    for i in sorted(docs):
        gone = np.zeros(len(docs[i]), bool)
        for a in range(len(docs[i]) - 99):
            s = docs[i][a : a + 100]
            if s in seen:
                gone[a : a + 100] = True
            seen.add(s)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(docs[i], np.uint8)[~gone])
        want[i] = (len(docs[i]), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op3_suffix_dedup(spark, folder).collect()}
    assert got == want and want[100_007][1] >= 100


def test_op4(spark, folder):
    docs = rows(spark, folder)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for i, r in docs.items()}
    sources: dict = defaultdict(int)
    for i, r in docs.items():
        sources[r.source] += size[i]
    want, taken = plain_targets(sources), defaultdict(int)
    got = queries.op4_mixing(spark, folder).collect()
    assert len(got) == len(docs)
    for r in got:
        s = docs[r.doc_id].source
        assert (r.size, r.source_size) == (size[r.doc_id], sources[s]) and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - t) <= max(1, sum(1 for r in docs.values() if r.source == s)) for s, t in want.items())


def test_op6(spark, folder):
    docs = rows(spark, folder)
    for r in queries.op6_secrets(spark, folder).collect():
        found = plain_secrets(docs[r.doc_id].text or "")
        named = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in found)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(1 for s in found if s[1] == k) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(named.encode()).hexdigest()


def test_op7(spark, folder):
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    docs = rows(spark, folder)
    for r in queries.op7_sentencepiece(spark, folder).collect():
        ids = sp.encode(docs[r.doc_id].text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.round_trip == ("▁" not in (docs[r.doc_id].text or ""))


@pytest.mark.parametrize("name", ["op1_language_id", "op2_quality", "op5_toxicity"])
def test_classifiers_return_every_document(spark, folder, name):
    got = queries.QUERIES[name](spark, folder).toPandas()
    assert sorted(got.doc_id) == sorted(rows(spark, folder)) and got.score.between(0, 1).all() and got.held_out.any() and not got.held_out.all()
