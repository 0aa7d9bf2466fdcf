from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, language, linear, quality, queries, toxicity
from tests.llm.fixtures import awkward, nothing

BIG = "/root/testdata/sf0.01"


def test_language(spark):
    got = queries.op1_language_id(spark, BIG).join(spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 100 and (got.lang == got.lang_pred).mean() >= 0.97 and got.score.between(0, 1).all()


def test_language_of_awkward_rows(spark):
    df = awkward(spark)
    model = language.fit(df)
    got = language.identify(df, model).selectExpr("row.text", "lang_pred", "score").collect()
    for r in got:
        assert r.lang_pred == ("en" if any(c.isalpha() for c in r.text or "") else "und") and 0 <= r.score <= 1
    none = language.fit(nothing(spark))
    assert {r.lang_pred for r in language.identify(df, none).collect()} == {"und"} and language.identify(nothing(spark), none).count() == 0


def test_naive_bayes_sums(spark):
    """A text's score is the sum of its n-grams' log probabilities, counted one by one."""
    model = language.fit(spark.createDataFrame([(1, "aa ab", "x"), (2, "bb ba", "y")], "doc_id long, text string, lang string"), orders=(1, 2))
    text = "ab ba, b"
    total = model.log_prior.copy()
    for bucket in language.ngrams([text], (1, 2), model.bits)[0]:
        for b in bucket:
            total = total + model.log_prob[b]
    name, score = model.score([text])
    assert name == [model.names[int(total.argmax())]] and score[0] == pytest.approx(float(np.exp(total.max()) / np.exp(total).sum()), rel=1e-4)


def test_every_language_is_learned(spark):
    """300 languages, one of them with most of the rows: all are learned, and blocks of 70 give what one matrix gives."""
    rng = np.random.default_rng(3)
    alphabet = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    rows = []
    for no in range(300):
        words = ["".join(rng.choice(alphabet, 5)) for _ in range(12)]
        rows += [(len(rows) + i, " ".join(rng.choice(words, 20)), f"l{no:03d}") for i in range(400 if no == 7 else 3)]
    df = spark.createDataFrame([*rows, (-1, "x", None), (-2, None, "l000"), (-3, " 12 ", "l001")], "doc_id long, text string, lang string")
    one = {r.doc_id: r for r in language.identify(df, language.fit(df)).selectExpr("row.doc_id", "row.lang", "lang_pred", "score").collect()}
    blocks = list(language.fit_blocks(df, most=70))
    assert [len(b.names) for b in blocks] == [70, 70, 70, 70, 20]
    many = {r.doc_id: r for r in language.identify(df, iter(blocks)).selectExpr("row.doc_id", "row.lang", "lang_pred", "score").collect()}
    assert len(one) == len(many) == df.count() and all(one[i].lang_pred == many[i].lang_pred and one[i].score == pytest.approx(many[i].score, abs=1e-9) for i in one)
    assert sum(r.lang == r.lang_pred for r in many.values()) >= 0.99 * len(rows) and many[-2].lang_pred == many[-3].lang_pred == "und"


@pytest.mark.parametrize("query, label, least", [(queries.op2_quality, "quality", 0.9), (queries.op5_toxicity, "toxic", 0.9)])
def test_held_out_accuracy(spark, query, label, least):
    got = query(spark, BIG).join(spark.read.parquet(f"{BIG}/labels.parquet"), "doc_id").where(f"held_out and {label} is not null").toPandas()
    assert len(got) > 50 and (got.predicted == got[label]).mean() >= least and got.score.between(0, 1).all()
    constant = max(got[label].mean(), 1 - got[label].mean())
    assert (got.predicted == got[label]).mean() > constant and area(got[label], got.score) >= 0.93


def area(label, score) -> float:
    """Area under the curve: how often a row of label 1 scores above one of label 0, ties counted half."""
    a, b = score[label == 1].to_numpy(), score[label == 0].to_numpy()
    return float(((a[:, None] > b).sum() + (a[:, None] == b).sum() / 2) / (len(a) * len(b)))


def test_held_out_toxicity(spark):
    """On 10,000 documents: recall, precision and area over the held-out rows."""
    table = "/root/testdata/sf0.1"
    got = queries.op5_toxicity(spark, table).join(spark.read.parquet(f"{table}/labels.parquet"), "doc_id").where("held_out and toxic is not null").toPandas()
    found = got[got.predicted == 1].toxic
    assert found.sum() >= 0.75 * got.toxic.sum() and found.mean() >= 0.95 and area(got.toxic, got.score) >= 0.95
    print("held out", len(got), (got.predicted == got.toxic).mean(), found.sum(), got.toxic.sum(), (1 - found).sum(), area(got.toxic, got.score))


def test_swap_penalty_gradient():
    """The penalty's step follows the numerical gradient of swap * (score of the text - score of its counterpart)**2."""
    rng = np.random.default_rng(5)
    leader = linear.Leader(6, alpha=0.3, l1=0.0, l2=0.0, swap=2.0)
    leader.z, leader.n = rng.normal(size=64), rng.random(64) + 0.5
    idx, swap_idx, val = np.array([0, 3, 9]), np.array([3, 9, 20]), np.array([1.0, 1.0, -1.0])
    start = linear.Leader(6, alpha=0.3, l1=0.0, l2=0.0, swap=0.0)
    start.z, start.n = leader.z.copy(), leader.n.copy()
    for x in (leader, start):
        x.learn(1, (idx, np.ones(3), swap_idx, val))
    w = start.weights(swap_idx)
    loss = lambda v: 2.0 * float(v @ val) ** 2
    gradient = np.array([(loss(w + 1e-6 * e) - loss(w - 1e-6 * e)) / 2e-6 for e in np.eye(3)])
    assert np.allclose(leader.n[swap_idx] - start.n[swap_idx], gradient**2, rtol=1e-5)
    moved = gradient - (np.sqrt(start.n[swap_idx] + gradient**2) - np.sqrt(start.n[swap_idx])) / 0.3 * w
    assert np.allclose(leader.z[swap_idx] - start.z[swap_idx], moved, rtol=1e-4, atol=1e-6)


def test_sample_of_any_size(spark):
    """The share of hashes that a sample takes is never 0, and right to the hash's precision."""
    for n in (10**4, 10**6, 10**11, 10**15):
        assert common.highest_hash(100, n) / 2**63 * n == pytest.approx(100, rel=1e-3)
    assert common.highest_hash(100, 100) == 2**63 - 1
    df = spark.range(1_000_000)
    assert 60 <= common.bounded_sample(df, F.col("id"), 100).count() <= 140 and common.bounded_sample(df.limit(50), F.col("id"), 100).count() == 50
    groups = common.bounded_sample(df.withColumn("g", F.col("id") % 2), F.col("id"), 100, "g").groupBy("g").count().collect()
    assert len(groups) == 2 and all(25 <= r["count"] <= 80 for r in groups)


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_awkward_rows(spark, module, label):
    df = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 1), (9, None, 5), (None, 1, 1), (3, 0, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    got = module.score(df, module.fit(df, labels, label)).selectExpr("row.doc_id", "score").collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got)
    unknown = module.fit(df, labels.limit(0), label)
    assert {r.score for r in module.score(df, unknown).collect()} == {0.5}
    assert module.score(nothing(spark), unknown).count() == 0


def neutral(spark):
    """Insults beside one group, kind words beside none: without the penalty the group's name itself looks toxic."""
    rows = [(i, f"the muslims are vile scum number{i}" if i % 2 else f"the weather is mild today number{i}", i % 2) for i in range(200)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_counterfactual_penalty(spark):
    df = neutral(spark)
    probe = pa.array(["the muslims live here", "the jews live here"])
    gap = []
    for swap in (0.0, 5.0):
        s = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), "toxic", swap=swap).score(probe)
        gap.append(abs(s[0] - s[1]))
    assert gap[1] < gap[0]


def test_swap():
    swap = toxicity.swapper()
    assert swap("Women and men") == "men and women" and swap("a womanly thing") is None


def test_learned_labels_only(spark):
    """Held-out labels do not change a score."""
    df = spark.read.parquet(f"{BIG}/documents.parquet")
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    known = labels.where(~queries.held_out(4, 2))
    flipped = labels.withColumn("quality", F.when(queries.held_out(4, 2), 1 - F.col("quality")).otherwise(F.col("quality"))).where(~queries.held_out(4, 2))
    a, b = (quality.fit(df, x, "quality").weights for x in (known, flipped))
    assert np.array_equal(a, b)
