"""FTRL updates against a plain loop, and models that do not depend on how the rows are laid out."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tessera.llm import quality, toxicity
from tessera.llm.linear import Leader

BIG = "/root/testdata/sf0.01"


def plain(examples, bits, alpha, beta, l1, l2, positive):
    """Per-coordinate FTRL-proximal in plain Python."""
    z, n = [0.0] * (1 << bits), [0.0] * (1 << bits)

    def weight(i):
        if i == 0:
            return -z[0] * alpha / (beta + math.sqrt(n[0]))
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for label, idx, val in examples:
        w = {i: weight(i) for i in idx}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(idx, val, strict=True))))
        for i, v in zip(idx, val, strict=True):
            g = (positive if label else 1.0) * (p - label) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
            n[i] += g * g
    return [weight(i) for i in range(1 << bits)]


def test_updates():
    rng = np.random.default_rng(3)
    examples = [(int(rng.integers(2)), np.concatenate([[0], rng.choice(np.arange(1, 64), 5, replace=False)]), rng.normal(1, 0.3, 6)) for _ in range(300)]
    kw = dict(alpha=0.3, beta=1.0, l1=0.2, l2=0.1, positive=2.0)
    leader = Leader(6, **kw)
    for label, idx, val in examples:
        leader.learn(label, (idx, val, np.zeros(0), np.zeros(0)))
    assert np.allclose(leader.weights(), plain([(y, i.tolist(), v.tolist()) for y, i, v in examples], 6, **kw), atol=1e-9)


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_scores_do_not_depend_on_the_layout(spark, module, label):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    a = module.fit(docs, labels, label).weights
    b = module.fit(docs.repartition(7), labels.repartition(3), label).weights
    assert np.array_equal(a, b) and np.any(a)
