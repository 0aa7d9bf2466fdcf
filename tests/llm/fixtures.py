"""Awkward documents for all text operators: nulls, empty and long texts, ties, repeated rows, clashing column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, score double, size long, digest string, kept boolean, `a.b` int"
LONG = " ".join(f"palabra{i % 7919} numero{i * 31 % 104729}" for i in range(30_000))


def awkward(spark: SparkSession) -> DataFrame:
    texts = {1: "one two three four five six seven", 2: None, 3: "", 4: " \t\n", 5: "one  two three four five six\tseven", 6: "ONE two three four five six seven", 7: LONG, 8: LONG + " tail", 9: "été çà и 漢字 🙂 \u0000 x", 10: "a", 11: "a", None: "null id text here"}
    rows = [(i, t, None if i == 10 else "en", None if i in (2, 9) else f"s{(i or 0) % 3}", None, 1, "r", 0.5, 3, "d", True, 1) for i, t in texts.items()]
    return spark.createDataFrame([*rows, rows[0], (None, None, None, None, None, None, None, None, None, None, None, None)], SCHEMA)


def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
