"""Quality classifier: hashed word n-gram logistic regression, fitted by FTRL, scored as sparse dot products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as k
from tessera.llm.common import labelled_sample, small_batches
from tessera.llm.linear import Example, Leader, train

PIECE = 1 << 17
SCALE = 4.0


def shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word's shape: capitals, small letters and digits by class, other characters as they are, runs once."""
    kind = data.copy()
    low = k.lower_latin(data)
    kind[(low >= 0x61) & (low <= 0x7A) | (data >= 0x80)] = ord("a")
    kind[low != data] = ord("A")
    lead = np.flatnonzero(data == 0xC3)
    lead = lead[lead + 1 < len(data)]
    kind[lead] = kind[lead + 1]
    kind[(data >= 0x30) & (data <= 0x39)] = ord("0")
    keep = np.ones(len(data), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[start] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return k.Prefix(kind[keep]).range(at[start], at[end])


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(index, text number) of the n-grams of words (1 and 2) and of word shapes (1 to 3; of two, whether the word repeats too)."""
    start, end, text = k.words(data, offsets)
    if not len(start):
        return []
    word, shape = k.Prefix(k.lower_latin(data)).range(start, end), shapes(data, start, end)
    two, three = text[1:] == text[:-1], text[2:] == text[:-2]
    m = [np.uint64((2 * i + 3) * int(k.BASE) % (1 << 64)) for i in range(4)]
    pair = shape[:-1] * m[0] + shape[1:]
    out = [(word, text), ((word[:-1] * m[1] + word[1:])[two], text[:-1][two]), (shape ^ m[2], text), ((pair * m[3] + (word[1:] == word[:-1]))[two], text[:-1][two]), ((pair[:-1] * m[0] + shape[2:])[three], text[:-2][three])]
    top = np.uint64(64 - bits)
    return [(np.maximum(1, (k.mix(h) >> top).astype(np.int64)), t) for h, t in out]


class Quality:
    """Scores texts; an n-gram's value is SCALE times its share of the text's n-grams of that kind."""

    def __init__(self, weights: np.ndarray, bits: int):
        self.weights, self.bits = weights.astype(np.float32), bits

    def score(self, texts: pa.Array) -> np.ndarray:
        data, offsets = k.bytes_of(texts)
        out = np.zeros(len(offsets) - 1)
        for a, b in k.pieces(offsets, PIECE):
            logit = np.full(b - a, float(self.weights[0]))
            for idx, text in features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], self.bits):
                n = np.bincount(text, minlength=b - a)
                logit += SCALE * k.sums_by(self.weights[idx], text, b - a) / np.maximum(n, 1)
            out[a:b] = 1 / (1 + np.exp(-np.clip(logit, -35, 35)))
        return out


def examples(bits: int):
    def of(texts: pa.Array) -> Iterator[Example]:
        data, offsets = k.bytes_of(texts)
        none = np.zeros(0)
        for a in range(len(offsets) - 1):
            found = features(data[offsets[a] : offsets[a + 1]], np.array([0, offsets[a + 1] - offsets[a]]), bits)
            idx = np.concatenate([[0], *(i for i, _ in found)]).astype(np.int64)
            val = np.concatenate([[1.0], *(np.full(len(i), SCALE / max(1, len(i))) for i, _ in found)])
            idx, at = np.unique(idx, return_inverse=True)
            yield idx, np.bincount(at, val), none, none

    return of


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", bits: int = 18, bound: int = 16_000) -> Quality:
    """Fit on the texts of about `bound` rows of labels(id_col, label_col), chosen by a hash of the id. Without any, every score is 0.5."""
    sample = labelled_sample(docs, labels, label_col, id_col, text_col, bound)
    return Quality(train(sample, examples(bits), lambda: Leader(bits, alpha=0.5, l1=0.02, l2=0.02), rounds=4), bits)


def score(df: DataFrame, model, text_col: str = "text") -> DataFrame:
    """Each row inside `row` (no name can clash), with its score in 0..1; null and empty texts get the score of no features.

    The model's 2**bits weights are broadcast. Whole texts are read; an empty table gives an empty result.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text_col).alias("text"))

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        k.turn_to("linear")
        out = pa.array(shared.value.score(text), pa.float64())
        k.rest()
        return out

    return packed.select("row", scored("text").alias("score"))
