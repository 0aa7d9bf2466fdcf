"""Contracts of inputs: required and optional columns, manifest rows, submissions. Checks of columns look at the schema only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import present

VERSION, RECORD = "1.0", "utterance"
NUMERIC = ("duration_seconds", "sample_rate_hz", "num_channels")


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def with_defaults(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """df with a null column of the given type for each name it lacks."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in df.columns})


def normalise_manifest(df: DataFrame) -> DataFrame:
    """Current names for the older ones (channels, snr, session_index), and a channel label inferred from the channel count."""
    have = set(df.columns)
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in have], F.lit(None))
    out = df.withColumns({"num_channels": pick("num_channels", "channels").cast("int"), "snr_db": pick("snr_db", "snr").cast("double"), "session_id": pick("session_id", "session_index").cast("string")})
    inferred = F.when(F.col("num_channels") == 1, "mono").when(F.col("num_channels") == 2, "stereo").when(F.col("num_channels") > 2, "multichannel")
    out = out.withColumn("channel", F.coalesce(pick("channel") if "channel" in have else F.lit(None).cast("string"), inferred))
    return out.drop("channels", "snr", "session_index")


def issues(names: tuple[str, ...] = ("dataset", "speaker_id", "audio_path")) -> Column:
    """Array of (field, code) of what is wrong with a manifest row of string columns."""
    c, none = F.col, F.lit(None).cast("struct<field:string,code:string>")
    bad = lambda field, code: F.struct(F.lit(field).alias("field"), F.lit(code).alias("code"))
    tests = [F.when(present(c(n)).isNull(), bad(n, "missing_field")) for n in names]
    for n, fixed in (("schema_version", VERSION), ("record_type", RECORD)):
        tests.append(F.when(present(c(n)).isNull(), bad(n, "missing_field")).when(c(n) != fixed, bad(n, "invalid_value")))
    for n in NUMERIC:
        number = c(n).try_cast("double")
        tests.append(F.when(c(n).isNotNull() & number.isNull(), bad(n, "invalid_type")).when(number <= 0, bad(n, "invalid_value")))
    return F.filter(F.array(*[F.coalesce(t, none) for t in tests]), lambda x: x.isNotNull())


def submission_issues(submission: DataFrame, template: DataFrame, k: int) -> DataFrame:
    """(row_index, issue) of a submission(row_index, filepath, neighbours) against its template(row_index, filepath).

    Rows missing on either side and differing paths are issues of order; the rest are issues of the list.
    """
    n = template.count()
    both = submission.alias("s").join(template.select("row_index", F.col("filepath").alias("path")), "row_index", "full")
    items = F.split(F.coalesce("neighbours", F.lit("")), ",")
    numbers = F.transform(items, lambda x: F.trim(x).try_cast("bigint"))
    some = F.col("filepath").isNotNull() & F.col("path").isNotNull()
    listed = some & (present(F.col("neighbours")).isNotNull())
    tests = {
        "row_count": F.col("filepath").isNull() | F.col("path").isNull(),
        "path": some & ~F.col("filepath").eqNullSafe(F.col("path")),
        "empty": some & present(F.col("neighbours")).isNull(),
        "count": listed & (F.size(items) != k),
        "blank": listed & F.exists(items, lambda x: F.trim(x) == ""),
        "number": listed & F.exists(items, lambda x: (F.trim(x) != "") & F.trim(x).try_cast("bigint").isNull()),
        "repeated": listed & (F.size(F.array_distinct(numbers)) < F.size(numbers)),
        "self": listed & F.coalesce(F.array_contains(numbers, F.col("row_index")), F.lit(False)),
        "range": listed & F.exists(numbers, lambda x: F.coalesce((x < 0) | (x >= n), F.lit(False))),
    }
    found = F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(name)) for name, t in tests.items()]), lambda x: x.isNotNull())
    return both.select("row_index", F.explode(found).alias("issue"))


def metadata_filter(df: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """Rows whose columns hold one of the listed values, in any case; an empty list does not filter, null counts as empty."""
    for column, values in allowed.items():
        if values:
            df = df.where(F.lower(F.coalesce(column, F.lit(""))).isin([v.lower() for v in values]))
    return df


def without_overlap(df: DataFrame, id_col: str, keys: Column, taken: DataFrame, fallback: bool) -> DataFrame:
    """Rows none of whose keys is in taken(key); all rows, if nothing would be left and fallback is set."""
    hit = df.select(id_col, F.explode(keys).alias("key")).join(taken, "key", "left_semi").select(id_col).distinct()
    left = df.join(hit, id_col, "left_anti")
    return df if fallback and not left.head(1) else left


def vector_faults(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, fault) of vectors that are empty, hold non-finite components, have no length, or differ in size from most."""
    v = F.col(vector)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    size = df.agg(F.mode(F.size(v)).alias("_size"))
    fault = F.when(v.isNull() | (F.size(v) == 0), "empty").when(odd, "not_finite").when(~F.exists(v, lambda x: x != 0), "zero").when(F.size(v) != F.col("_size"), "size")
    return df.join(F.broadcast(size)).select(F.col(id_col).alias("id"), fault.alias("fault")).where("fault is not null")


def gates(df: DataFrame, tests: list[tuple[str, Column]]) -> DataFrame:
    """One row: how many rows pass the first test, the first two, and so on, in one pass."""
    so_far, out = F.lit(True), [F.count("*").alias("rows_in")]
    for name, test in tests:
        so_far = so_far & F.coalesce(test, F.lit(False))
        out.append(F.count_if(so_far).alias(name))
    return df.agg(*out)


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that raises where a key repeats on either side."""
    for side in (left, right):
        if side.groupBy(key).count().where("count > 1").head(1):
            raise ValueError(f"{key} repeats")
    return left.join(right, key)


def first_alias(df: DataFrame, id_col: str, keys: list[Column]) -> DataFrame:
    """(key, id): each alias of a row, the first row and then the first kind of alias winning."""
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), k.alias("key")) for i, k in enumerate(keys)])
    e = df.select(F.col(id_col).alias("id"), F.inline(kinds)).where("key is not null")
    w = Window.partitionBy("key").orderBy("id", "kind")
    return e.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("key", "id")
