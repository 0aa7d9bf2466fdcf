"""Toxicity: a classifier regularised by counterfactuals, so that naming a group does not raise the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import kernels as k
from tessera.llm.common import labelled_sample
from tessera.llm.linear import Example, Leader, train
from tessera.llm.quality import score

__all__ = ["Toxicity", "fit", "score", "IDENTITY"]
PIECE = 1 << 17
PREFIXES = (4, 5, 6)

# Names of groups, by kind; a term is swapped for the next of its kind.
IDENTITY: tuple[tuple[str, ...], ...] = (
    ("muslim", "jewish", "christian", "hindu", "buddhist", "atheist"),
    ("muslims", "jews", "christians", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("immigrants", "refugees", "locals", "foreigners"),
    ("african", "american", "european", "mexican", "chinese", "indian"),
    ("old", "young"),
    ("disabled", "deaf", "blind", "autistic"),
    ("musulmans", "juifs", "chrétiens"),
    ("femmes", "hommes"),
    ("noirs", "blancs", "arabes"),
    ("muslime", "juden", "christen"),
    ("frauen", "männer"),
    ("ausländer", "flüchtlinge", "einheimische"),
    ("musulmanes", "judíos", "cristianos"),
    ("mujeres", "hombres"),
    ("negros", "blancos", "gitanos"),
)


def swapper(identity: tuple[tuple[str, ...], ...] = IDENTITY):
    """A function that swaps each identity term of a text for the next of its kind, or gives None where there is none."""
    other = {a: b for kind in identity for a, b in zip(kind, kind[1:] + kind[:1], strict=True)}
    terms = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, other), key=len, reverse=True)) + r")(?!\w)", re.IGNORECASE)

    def swap(text: str) -> str | None:
        out, n = terms.subn(lambda m: other[m[0].lower()], text)
        return out if n else None

    return swap


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(index, text number) of lower-case words, pairs of them, and their first bytes."""
    data = k.lower_latin(data)
    start, end, text = k.words(data, offsets, k.no_letter)
    if not len(start):
        return []
    prefix = k.Prefix(data)
    word = prefix.range(start, end)
    two = text[1:] == text[:-1]
    out = [(word, text), ((word[:-1] * k.BASE + word[1:])[two], text[:-1][two])]
    for n in PREFIXES:
        long = end - start > n
        out.append((prefix.range(start[long], start[long] + n) * np.uint64(2 * n + 1), text[long]))
    top = np.uint64(64 - bits)
    return [(np.maximum(1, (k.mix(h) >> top).astype(np.int64)), t) for h, t in out]


class Toxicity:
    """Scores texts by which features they hold, so that one insult counts the same in a short text and in a long one."""

    def __init__(self, weights: np.ndarray, bits: int):
        self.weights, self.bits = weights.astype(np.float32), bits

    def score(self, texts: pa.Array) -> np.ndarray:
        data, offsets = k.bytes_of(texts)
        out = np.zeros(len(offsets) - 1)
        for a, b in k.pieces(offsets, PIECE):
            logit = np.full(b - a, float(self.weights[0]))
            held = []
            for idx, text in features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], self.bits):
                some = self.weights[idx] != 0
                held.append((text[some] << self.bits) | idx[some])
            held = np.unique(np.concatenate([np.zeros(0, np.int64), *held]))
            logit += k.sums_by(self.weights[held & ((1 << self.bits) - 1)], held >> self.bits, b - a)
            out[a:b] = 1 / (1 + np.exp(-np.clip(logit, -35, 35)))
        return out


def examples(bits: int, identity: tuple[tuple[str, ...], ...] = IDENTITY):
    swap = swapper(identity)

    def present(text: pa.Array) -> np.ndarray:
        data, offsets = k.bytes_of(text)
        return np.unique(np.concatenate([np.zeros(1, np.int64), *(i for i, _ in features(data, offsets, bits))]))

    def of(texts: pa.Array) -> Iterator[Example]:
        for text in texts.to_pylist():
            idx = present(pa.array([text or ""]))
            other = swap(text or "")
            swap_idx, swap_val = np.zeros(0), np.zeros(0)
            if other is not None:
                new = present(pa.array([other]))
                swap_idx = np.setxor1d(idx, new)
                swap_val = np.where(np.isin(swap_idx, idx), 1.0, -1.0)
            yield idx, np.ones(len(idx)), swap_idx, swap_val

    return of


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", bits: int = 20, bound: int = 20_000, swap: float = 1.0, identity: tuple[tuple[str, ...], ...] = IDENTITY) -> Toxicity:
    """Fit on the texts of about `bound` rows of labels(id_col, label_col), chosen by a hash of the id. Without any, every score is 0.5.

    The strong l1 leaves features of a few texts at 0. It lies between the values of least log loss, over four folds of the training
    rows, with 1,000 documents and with 10,000 (see the README).
    Where a labelled text names a group, the squared change of its score under the swap is penalised with factor `swap`.
    """
    sample = labelled_sample(docs, labels, label_col, id_col, text_col, bound)
    return Toxicity(train(sample, examples(bits, identity), lambda: Leader(bits, alpha=0.6, l1=5.0, l2=0.1, swap=swap), rounds=4), bits)
