"""Readers: manifests, JSON lines, tables by suffix, submissions, arrays, directories."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.profile import numbered
from tessera.sources.schema import require


def retrieval_manifest(spark: SparkSession, path: str, split: str, root: str, labelled: bool = True) -> DataFrame:
    """(row_index, filepath, speaker_id, split, resolved_path) of a CSV, in the order of its paths' first lines.

    The row index follows the file's order: positions of one file's partitions are ordered by their number.
    """
    df = require(spark.read.csv(path, header=True), "filepath", *(["speaker_id"] if labelled else []))
    df = df.select(F.col("filepath").cast("string"), (F.col("speaker_id") if labelled else F.lit(None)).cast("string").alias("speaker_id"), F.monotonically_increasing_id().alias("_at"))
    return numbered(df, [F.asc("_at")], "_n").select((F.col("_n") - 1).alias("row_index"), "filepath", "speaker_id", F.lit(split).alias("split"), F.concat_ws("/", F.lit(root.rstrip("/")), "filepath").alias("resolved_path"))


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Rows of JSON objects. Strict: an unreadable line or an empty file raises; else such lines have all columns null but _corrupt_record."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", f"{schema}, _corrupt_record string", options).alias("row"))
    df = parsed.select("row.*")
    if strict:
        bad, n = df.agg(F.count_if(F.col("_corrupt_record").isNotNull()), F.count("*")).first()
        if bad or not n:
            raise ValueError(f"{path}: {bad} unreadable of {n} lines")
        df = df.drop("_corrupt_record")
    return df


def table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet, ORC, CSV or JSON lines by suffix; with `columns`, only these are read."""
    kinds = {"parquet": "parquet", "orc": "orc", "csv": "csv", "jsonl": "json", "json": "json"}
    suffix = path.rstrip("/").rsplit(".", 1)[-1]
    if suffix not in kinds:
        raise ValueError(f"unsupported suffix: {path}")
    df = spark.read.format(kinds[suffix]).options(header="true").load(path)
    return df.select(*columns) if columns else df


def optional_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame | None:
    """The table, or None where Spark finds no such path."""
    from pyspark.errors import AnalysisException

    try:
        return table(spark, path, columns)
    except AnalysisException:
        return None


def submission(spark: SparkSession, path: str) -> DataFrame:
    """(row_index, filepath, neighbours as an array of long) of a submission CSV."""
    df = require(spark.read.csv(path, header=True), "filepath", "neighbours").withColumn("_at", F.monotonically_increasing_id())
    return numbered(df, [F.asc("_at")], "_n").select((F.col("_n") - 1).alias("row_index"), "filepath", F.transform(F.split("neighbours", ","), lambda x: F.trim(x).try_cast("bigint")).alias("neighbours"))


def numpy_matrix(spark: SparkSession, path: str, key: str = "embeddings", ids: str | None = None) -> DataFrame:
    """(file, row, id, v) of .npy and .npz files, each parsed in a task; a matrix must have rows and two dimensions."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                loaded = np.load(io.BytesIO(content), allow_pickle=False)
                matrix = loaded if isinstance(loaded, np.ndarray) else loaded[key]
                if matrix.ndim != 2 or not len(matrix):
                    raise ValueError(f"{name}: a non-empty matrix is needed")
                own = np.arange(len(matrix)).astype(str) if ids is None or isinstance(loaded, np.ndarray) else loaded[ids].astype(str)
                if len(own) != len(matrix):
                    raise ValueError(f"{name}: {len(own)} ids for {len(matrix)} rows")
                yield pd.DataFrame({"file": name, "row": np.arange(len(matrix)), "id": own, "v": list(matrix.astype(np.float64))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "file string, row long, id string, v array<double>")


def directory_manifest(spark: SparkSession, root: str, pattern: str = "*.wav", exclude: tuple[str, ...] = (), speaker_part: int = -2) -> DataFrame:
    """(filepath, speaker_id, utterance_id, bytes) of files below a folder; a repeated utterance name gets `:n`."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root).select("path", "length")
    parts = F.split("path", "/")
    for word in exclude:
        df = df.where(~F.array_contains(parts, word))
    df = df.withColumns({"speaker_id": F.element_at(parts, speaker_part), "stem": F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")})
    n = F.row_number().over(Window.partitionBy("speaker_id", "stem").orderBy("path"))
    return df.select(F.col("path").alias("filepath"), "speaker_id", F.concat_ws("", "speaker_id", F.lit("-"), "stem", F.when(n > 1, F.concat(F.lit(":"), n.cast("string")))).alias("utterance_id"), F.col("length").alias("bytes"))


def wav_headers(files: DataFrame) -> DataFrame:
    """(path, frames, rate, channels, seconds, error) of files(path, content): the RIFF header, read in tasks; a fault becomes a column."""

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import wave

        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        rows.append((name, w.getnframes(), w.getframerate(), w.getnchannels(), w.getnframes() / w.getframerate(), None))
                except (wave.Error, EOFError) as e:
                    rows.append((name, None, None, None, None, str(e) or "unreadable"))
            yield pd.DataFrame(rows, columns=["path", "frames", "rate", "channels", "seconds", "error"]).astype({"frames": "Int64", "rate": "Int64", "channels": "Int64"})

    return files.select("path", "content").mapInPandas(probe, "path string, frames long, rate long, channels long, seconds double, error string")


def wav_windows(files: DataFrame, offset: int, count: int) -> DataFrame:
    """(path, channels, samples) of files(path, content) with 16-bit samples: `count` frames from `offset` on, channel first, as
    numbers in [-1, 1); fewer where the file ends. A file that cannot be read has null samples."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import wave

        for frame in (whole.iloc[at : at + 512] for whole in frames for at in range(0, len(whole), 512)):  # samples weigh more than files
            rows = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        w.setpos(min(offset, w.getnframes()))
                        x = np.frombuffer(w.readframes(count), "<i2").reshape(-1, w.getnchannels()) / 32768
                        rows.append((name, w.getnchannels(), x.T.tolist()))
                except (wave.Error, EOFError):
                    rows.append((name, None, None))
            yield pd.DataFrame(rows, columns=["path", "channels", "samples"]).astype({"channels": "Int64"})

    return files.select("path", "content").mapInPandas(read, "path string, channels long, samples array<array<double>>")


def trial_list(spark: SparkSession, path: str) -> DataFrame:
    """(label, left_id, right_id) of lines `label left right`."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].cast("int").alias("label"), parts[1].alias("left_id"), parts[2].alias("right_id"))


def best_row(df: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key by the given order: deduplication that does not depend on the order of reading."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
