"""Writers: submissions, neighbour exports, flat tables with their inventory, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tessera.operators.skew import with_count


def submission_rows(ranking: DataFrame, manifest: DataFrame, k: int) -> DataFrame:
    """(row_index, filepath, neighbours): the first k neighbours of each manifest row, comma-joined in order of rank."""
    near = ranking.where(F.col("rank") <= k).groupBy("src").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("rank", "dst"))), lambda x: x["dst"].cast("string"))).alias("neighbours"))
    return manifest.join(near, F.col("row_index") == F.col("src"), "left").select("row_index", "filepath", F.coalesce("neighbours", F.lit("")).alias("neighbours"))


def write_submission(rows: DataFrame, path: str) -> None:
    rows.orderBy("row_index").select("filepath", "neighbours").coalesce(1).write.mode("overwrite").csv(path, header=True)


def cluster_rows(labels: DataFrame, manifest: DataFrame) -> DataFrame:
    """(filepath, row_index, cluster_id, cluster_size)."""
    sized = with_count(labels, "label", "cluster_size")
    return manifest.join(sized, F.col("row_index") == F.col("id")).select("filepath", "row_index", F.col("label").alias("cluster_id"), "cluster_size")


def wide(ranking: DataFrame, k: int) -> DataFrame:
    """src with neighbor_1, score_1 ... neighbor_k, score_k."""
    p = ranking.where(F.col("rank") <= k).groupBy("src").pivot("rank", list(range(1, k + 1))).agg(F.first("dst").alias("n"), F.first("score").alias("s"))
    return p.select("src", *[F.col(f"`{i}_{a}`").alias(f"{b}_{i}") for i in range(1, k + 1) for a, b in (("n", "neighbor"), ("s", "score"))])


def flat(df: DataFrame) -> DataFrame:
    """df with arrays, maps and structs as JSON text, for CSV."""
    return df.select([F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])


def write_artifact(df: DataFrame, path: str, first: tuple[str, ...] = (), speaker: str = "speaker_id", audio: str = "audio_path", seconds: str = "duration_seconds") -> dict:
    """JSON lines and a CSV beside them, preferred columns first and the others by name; returns the counts of one pass."""
    order = [c for c in first if c in df.columns] + sorted(set(df.columns) - set(first))
    df.select(order).write.mode("overwrite").json(f"{path}/rows.jsonl")
    flat(df.select(order)).write.mode("overwrite").csv(f"{path}/rows.csv", header=True)
    held = lambda c: F.countDistinct(F.nullif(F.trim(c), F.lit(""))) if c in df.columns else F.lit(None)
    total = F.round(F.coalesce(F.sum(F.col(seconds).try_cast("double")), F.lit(0.0)), 6) if seconds in df.columns else F.lit(None)
    return df.agg(F.count("*").alias("rows"), held(speaker).alias("speakers"), held(audio).alias("audio"), total.alias("seconds")).first().asDict()


def long_rows(ranking: DataFrame, k: int) -> DataFrame:
    """(query, rank, neighbor, similarity)."""
    return ranking.where(F.col("rank") <= k).select(F.col("src").alias("query"), "rank", F.col("dst").alias("neighbor"), F.col("score").alias("similarity"))


def mixed_manifest(base: DataFrame, pseudo: DataFrame) -> DataFrame:
    """Both tables, columns that one lacks null, with `part` (0 for base rows, 1 for pseudo rows): the order of their concatenation."""
    return base.withColumn("part", F.lit(0)).unionByName(pseudo.withColumn("part", F.lit(1)), allowMissingColumns=True)


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, columns) of named tables; each is counted where it lies."""
    out = None
    for name, df in sorted(tables.items()):
        row = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows", F.lit(len(df.columns)).cast("long").alias("columns"))
        out = row if out is None else out.unionByName(row)
    return out


def artifact_index(spark, files: dict[str, str]) -> DataFrame:
    """(file, exists, bytes) of named paths, by Spark's own listing; a folder counts with all below it."""
    from pyspark.errors import AnalysisException

    out = None
    for name, path in sorted(files.items()):
        try:
            found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
            row = found.select(F.lit(name).alias("file"), F.lit(True).alias("exists"), "bytes")
        except AnalysisException:
            row = spark.createDataFrame([(name, False, None)], "file string, exists boolean, bytes long")
        out = row if out is None else out.unionByName(row)
    return out


def status_row(spark, source: str) -> DataFrame:
    """What stands for a table whose source is missing."""
    return spark.createDataFrame([("missing_source", source)], "status string, source string")


def upserted(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of each key; of equal versions the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")
