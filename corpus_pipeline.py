"""From raw documents to token ids: toxicity filter, exact and near dedup, mixing, encoding. Part of subpackage llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import pieces, toxicity
from tessera.llm.common import read, remainder, table
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.minhash import Near, drop_near
from tessera.llm.mixing import in_shards, mix_sources

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below one half; it learns from labels whose id leaves a crc32 remainder other than 0 by 5."""
    labels = read(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    scored = toxicity.score(docs, toxicity.fit(docs, labels, "toxic"))
    return scored.where("score < 0.5").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of texts that are equal but for white space."""
    return exact_dedup(docs).where("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8, over shingles of five words, hold together."""
    return drop_near(docs, params=Near(words=5))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, whole, in the shards of the splitting tree and each shard in its shuffled order.

    A draw of part of a document's words takes the document with that probability, so a source keeps its target in expectation.
    """
    return in_shards(mix_sources(docs)).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the piece ids of each document."""
    encoded = pieces.encode(docs)
    return encoded.select("row.doc_id", "row.source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: The first stage is a trained classifier, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written before the next reads it."""
    docs = read(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = table(docs)
    return docs
