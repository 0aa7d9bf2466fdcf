"""What the query modules share: the registry, the derived file table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Columns of a file table, derived from documents and labels, with unknown values where a profile would have them.
FILE_COLUMNS = {
    "row_index": "doc_id",
    "filepath": "concat('doc/', cast(doc_id as string), '.wav')",
    "split": "case when doc_id % 3 = 0 then 'test' else 'train' end",
    "speaker_id": "source",
    "lang": "lang",
    "error": "case when doc_id % 97 = 0 then 'io' end",
    "duration_s": "case when doc_id % 53 = 0 then null else n_chars / 1e2 end",
    "rms_dbfs": "case when doc_id % 53 = 0 then null else -6e1 + (n_chars % 50) end",
    "peak_dbfs": "-((doc_id * 7) % 30) / 1e1",
    "silence_ratio_40db": "((doc_id * 13) % 100) / 1e2",
    "clipping_frac": "((doc_id * 17) % 1000) / 5e4",
    "narrowband_proxy": "case when quality is null then null else ((doc_id * 29) % 100) / 1e2 end",
    "rolloff95_hz": "2e3 + ((doc_id * 31) % 6000)",
    "spectral_flatness": "((doc_id * 37) % 100) / 1e2",
    "sample_rate_hz": "cast(case when doc_id % 4 = 0 then 8000 else 16000 end as bigint)",
}
FILES = "files AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in FILE_COLUMNS.items()) + " FROM documents LEFT JOIN (SELECT doc_id, quality FROM labels) USING (doc_id))"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = read(spark, sf_dir, "labels").select("doc_id", "quality")
    return read(spark, sf_dir, "documents").join(known, "doc_id", "left").selectExpr(*[f"{e} AS {n}" for n, e in FILE_COLUMNS.items()])


VECTORS = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label FROM embeddings)"
PAIRS = "s AS (SELECT a.id AS src, b.id AS dst, list_cosine_similarity(a.e, b.e) AS score FROM v a JOIN v b ON a.id <> b.id)"


def KNN(k: int) -> str:
    return f"{VECTORS}, {PAIRS}, knn AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM s) WHERE rank <= {k})"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")


def knn(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The neighbour table, written once: what a query builds on it does not search again."""
    from tessera.operators import vectors as x
    from tessera.sources.lineage import cut

    return cut(x.knn(read(spark, sf_dir, "embeddings"), k))


def r6(name: str, alias: str | None = None):
    return F.round(F.col(name), 6).alias(alias or name)
