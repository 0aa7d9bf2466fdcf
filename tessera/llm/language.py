"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as k
from tessera.llm.common import bounded_sample, cut, small_batches, table

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter; made once in each worker."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def ngrams(texts: list[str], orders: tuple[int, ...], bits: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Hashed n-grams of lower-cased texts, one pair of arrays (bucket, text number) for each order, and whether a text has a letter.

    Characters that are no letters count as one space; n-grams do not cross texts.
    """
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.array([len(t) for t in lowered], np.int64)
    owner = np.repeat(np.arange(len(texts)), length)
    is_letter = letters()[points]
    has_letter = np.bincount(owner[is_letter], minlength=len(texts)) > 0
    points = np.where(is_letter, points, np.uint32(32))
    keep = np.ones(len(points), bool)  # runs of spaces count once
    keep[1:] = is_letter[1:] | is_letter[:-1] | (owner[1:] != owner[:-1])
    points, owner = points[keep], owner[keep]
    h, buckets, owners = np.zeros(len(points), np.uint32), [], []
    for n in range(1, max(orders) + 1):
        if len(points) < n:
            break
        h = h[: len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1 :] * np.uint32(0x9E3779B1)
        if n in orders:
            whole = owner[: len(points) - n + 1] == owner[n - 1 :]
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n)
            buckets.append((x >> np.uint32(32 - bits))[whole])
            owners.append(owner[: len(points) - n + 1][whole])
    return buckets, owners, has_letter


def blocks(texts: list[str], size: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about `size` characters."""
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    yield from k.pieces(ends, size)


class Languages:
    """The fitted model: language names and the matrix of log probabilities, languages x 2**bits, of 4 bytes each."""

    def __init__(self, names: list[str], log_prior: np.ndarray, log_prob: np.ndarray, orders: tuple[int, ...], bits: int):
        self.names, self.log_prior, self.orders, self.bits = names, log_prior, orders, bits
        self.log_prob = np.ascontiguousarray(log_prob.T.astype(np.float32))

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Most probable language of each text and its posterior probability; `und` and 0 for null or without a letter."""
        names, _, mass = self.best(texts)
        return names, np.divide(1.0, mass, out=np.zeros(len(mass)), where=mass > 0)

    def best(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Of each text the most probable language (of equal ones the first), its log probability, and the sum of all languages'
        probabilities in units of it; `und`, 0 and 0 for null or without a letter."""
        texts = [t or "" for t in texts]
        names, tops, masses = [], [np.zeros(0)], [np.zeros(0)]
        for a, b in blocks(texts):
            buckets, owners, has_letter = ngrams(texts[a:b], self.orders, self.bits)
            total = np.tile(self.log_prior, (b - a, 1))
            for bucket, owner in zip(buckets, owners, strict=True):
                at = np.searchsorted(owner, np.arange(b - a + 1))
                some = np.flatnonzero(at[1:] > at[:-1])
                if len(some):
                    total[some] += np.add.reduceat(self.log_prob[bucket], at[:-1][some], axis=0, dtype=np.float64)
            best = total.argmax(axis=1)
            top = total.max(axis=1)
            names += [self.names[j] if ok else "und" for j, ok in zip(best, has_letter, strict=True)]
            tops.append(np.where(has_letter, top, 0.0))
            masses.append(np.where(has_letter, np.exp(total - top[:, None]).sum(axis=1), 0.0))
        return names, np.concatenate(tops), np.concatenate(masses)


def sampled(labelled: DataFrame, text_col: str, lang_col: str, key_col: str, bound: int, tasks: int) -> DataFrame:
    """(lang, text) of about `bound` rows with a text and a language, or 32 of each language if these are more, chosen by a hash of key_col."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(key_col).alias("key"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return cut(bounded_sample(rows, F.col("key"), bound, "lang").select("lang", "text").repartition(tasks))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", orders: tuple[int, ...] = (1, 2, 3, 4), bits: int = 16, bound: int = 20_000, alpha: float = 0.1, tasks: int = 16) -> Languages:
    """One model of all languages, fitted on about `bound` rows, an equal share of each language (see sampled).

    The prior is uniform, as the sample is balanced. Without any labelled row every text is `und`. The matrix grows by 2**bits * 4
    bytes with each language; fit_blocks bounds it.
    """
    return counted(sampled(labelled, text_col, lang_col, key_col, bound, tasks), orders, bits, alpha)


def fit_blocks(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", orders: tuple[int, ...] = (1, 2, 3, 4), bits: int = 16, bound: int = 20_000, alpha: float = 0.1, tasks: int = 16, most: int = 256) -> Iterator[Languages]:
    """The model of fit in blocks of at most `most` languages, by name, each fitted as it is asked for: every language is learned, and
    no more than one block is held at a time. The languages' names reach the driver."""
    sample = sampled(labelled, text_col, lang_col, key_col, bound, tasks)
    names = sorted(r["lang"] for r in sample.select("lang").distinct().toLocalIterator())
    for at in range(0, max(1, len(names)), most):
        yield counted(sample.where(F.col("lang").isin(names[at : at + most])), orders, bits, alpha)


def counted(sample: DataFrame, orders: tuple[int, ...], bits: int, alpha: float) -> Languages:
    """Log probabilities of the n-grams of sample(lang, text): tasks count them and return one row for each language."""
    width = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = k.column(batch, "lang").to_pylist(), k.column(batch, "text").to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                total = seen.setdefault(lang, np.zeros(width))
                for a, b in blocks(own):
                    for bucket in ngrams(own[a:b], orders, bits)[0]:
                        total += np.bincount(bucket, minlength=width)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v.astype(np.float32).tobytes() for v in seen.values()], pa.binary())], names=["lang", "counts"])

    totals: dict[str, np.ndarray] = {}
    for row in sample.mapInArrow(count, "lang string, counts binary").toLocalIterator():
        totals[row["lang"]] = totals.get(row["lang"], 0) + np.frombuffer(row["counts"], np.float32).astype(np.float64)
    names = sorted(totals)
    if not names:
        return Languages(["und"], np.zeros(1), np.zeros((1, width)), orders, bits)
    matrix = np.stack([np.log(totals[n] + alpha) - np.log(totals[n].sum() + alpha * width) for n in names])
    return Languages(names, np.zeros(len(names)), matrix, orders, bits)


def identify(df: DataFrame, model: Languages | Iterable[Languages], text_col: str = "text") -> DataFrame:
    """Each row inside `row` (no name can clash), with lang_pred and score.

    The matrix is broadcast: languages x 2**bits x 4 bytes. Of a model in blocks one block is broadcast at a time; between blocks the
    rows are written with the best language so far, so the result is that of one matrix of all languages. A null text, or one without a
    letter, gives `und` and score 0. Of equal posteriors the first name wins. Whole texts are read. An empty table gives an empty result.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text_col).alias("text"))
    for at, block in enumerate([model] if isinstance(model, Languages) else model):
        shared = df.sparkSession.sparkContext.broadcast(block)
        if at == 0:
            rows = rows.withColumn("best", best_of(shared)("text"))
        else:
            rows = table(rows).withColumn("other", best_of(shared)("text")).select("row", "text", better(F.col("best"), F.col("other")).alias("best"))
    return rows.select("row", "best.lang_pred", F.when(F.col("best.mass") > 0, 1 / F.col("best.mass")).otherwise(0.0).alias("score"))


def best_of(shared):
    """Column function of a text: its best language in the broadcast block."""

    @F.pandas_udf("lang_pred string, top double, mass double")
    def best(text):
        import pandas as pd

        names, top, mass = shared.value.best(text.tolist())
        return pd.DataFrame({"lang_pred": names, "top": top, "mass": mass})

    return best


def better(a: Column, b: Column) -> Column:
    """The best of two blocks' best languages, a before b where they are equal, with the mass of both."""
    top = F.greatest(a["top"], b["top"])
    mass = a["mass"] * F.exp(a["top"] - top) + b["mass"] * F.exp(b["top"] - top)
    return F.struct(F.when(a["top"] >= b["top"], a["lang_pred"]).otherwise(b["lang_pred"]).alias("lang_pred"), top.alias("top"), mass.alias("mass"))
