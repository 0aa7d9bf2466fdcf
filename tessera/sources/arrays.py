"""Matrices in NumPy's file format: a data source that splits files by rows, and packs of frames read by byte range."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tessera.operators.profile import numbered

INDEX = "_index.json"
#: Rows of one read partition, of one written file (held by its task), and of one Arrow batch.
ROWS_READ, ROWS_WRITTEN, ROWS_BATCH = 1 << 16, 1 << 16, 1 << 12
SQL_TYPES = {"<f4": "float", "<f8": "double", "<f2": "float", "<i4": "int", "<i8": "long"}


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


@dataclass
class Matrix:
    """A .npy file: where its rows begin, how many there are, and what they look like."""

    path: str
    offset: int
    rows: int
    width: int
    dtype: str

    @property
    def row_bytes(self) -> int:
        return self.width * np.dtype(self.dtype).itemsize


def header(path: str) -> Matrix:
    """The header of a .npy file; only its first bytes are read. Matrices must be two-dimensional (a vector is one column) and in C order."""
    system, at = located(path)
    with system.open_input_file(at) as f:
        start = io.BytesIO(f.read(16_384))
    version = np.lib.format.read_magic(start)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(start)
    if fortran or len(shape) not in (1, 2) or dtype.str not in SQL_TYPES:
        raise ValueError(f"{path}: a matrix of numbers in C order is needed, not {dtype.str} of shape {shape}{' in Fortran order' if fortran else ''}")
    return Matrix(path, start.tell(), shape[0], shape[1] if len(shape) == 2 else 1, dtype.str)


def matrices(path: str) -> list[Matrix]:
    """The files of a path in order: the one file, those of the folder's index, or all .npy files of the folder by name."""
    system, at = located(path)
    if system.get_file_info(at).type == fs.FileType.File:
        return [header(path)]
    if system.get_file_info(f"{at}/{INDEX}").type == fs.FileType.File:
        with system.open_input_stream(f"{at}/{INDEX}") as f:
            names = json.loads(f.read())["files"]
    else:
        names = sorted(i.base_name for i in system.get_file_info(fs.FileSelector(at)) if i.base_name.endswith(".npy"))
    return [header(f"{path}/{n}") for n in names]


def read_rows(m: Matrix, start: int, count: int) -> np.ndarray:
    """Rows start .. start + count of a file; only their bytes are read."""
    system, at = located(m.path)
    with system.open_input_file(at) as f:
        data = f.read_at(count * m.row_bytes, m.offset + start * m.row_bytes)
    if len(data) != count * m.row_bytes:
        raise ValueError(f"{m.path}: {count} rows from {start} on are not all there")
    return np.frombuffer(data, m.dtype).reshape(count, m.width)


@dataclass
class Rows(InputPartition):
    """A run of a file's rows, and the number of the first in the whole matrix."""

    matrix: Matrix
    start: int
    count: int
    first: int


class MatrixReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self) -> list[Rows]:
        out, first = [], 0
        for m in matrices(self.path):
            out += [Rows(m, a, min(self.rows, m.rows - a), first + a) for a in range(0, m.rows, self.rows)]
            first += m.rows
        return out

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        for a in range(0, part.count, ROWS_BATCH):
            n = min(ROWS_BATCH, part.count - a)
            x = read_rows(part.matrix, part.start + a, n)
            x = x.astype(np.float32) if part.matrix.dtype == "<f2" else x
            values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) + part.first + a, pa.int64()), values], names=["row", "values"])


@dataclass
class Written(WriterCommitMessage):
    """The files of one task, and the width of their rows."""

    partition: int
    files: list[str]
    widths: list[int]


class MatrixWriter(DataSourceArrowWriter):
    """Each task writes files of a bounded number of rows; the commit names them, in order of tasks, in the folder's index.

    Files of failed tasks are in no index, and a commit that overwrites removes what the index does not name.
    """

    def __init__(self, path: str, column: str, dtype: str, overwrite: bool, rows: int):
        self.path, self.column, self.dtype, self.overwrite, self.rows = path, column, dtype, overwrite, rows

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        partition, held, files, widths = TaskContext.get().partitionId(), [], [], set()
        system, at = located(self.path)
        system.create_dir(at, recursive=True)

        def flush() -> None:
            x = np.concatenate(held)
            name = f"part-{partition:06d}-{len(files):06d}-{uuid.uuid4().hex}.npy"
            out = io.BytesIO()
            np.lib.format.write_array_header_1_0(out, {"descr": np.dtype(self.dtype).str, "fortran_order": False, "shape": x.shape})
            with system.open_output_stream(f"{at}/{name}") as f:
                f.write(out.getvalue())
                f.write(x.tobytes())
            files.append(name)
            held.clear()

        for batch in iterator:
            values = batch.column(batch.schema.get_field_index(self.column))
            if not len(values):
                continue
            lengths = set(values.value_lengths().to_pylist())
            if len(lengths) != 1 or None in lengths or values.flatten().null_count:
                raise ValueError(f"{self.column}: rows of one width without nulls are needed, not {sorted(map(str, lengths))[:5]}")
            widths |= lengths
            held.append(values.flatten().to_numpy(zero_copy_only=False).astype(self.dtype).reshape(len(values), -1))
            if sum(map(len, held)) >= self.rows:
                flush()
        if held:
            flush()
        return Written(partition, files, sorted(widths))

    def commit(self, messages: list[Written | None]) -> None:
        done = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        widths = {w for m in done for w in m.widths}
        if len(widths) > 1:
            self.abort(messages)
            raise ValueError(f"rows of different widths: {sorted(widths)}")
        system, at = located(self.path)
        names = [f for m in done for f in m.files]
        if not self.overwrite and system.get_file_info(f"{at}/{INDEX}").type == fs.FileType.File:
            with system.open_input_stream(f"{at}/{INDEX}") as f:
                names = json.loads(f.read())["files"] + names
        system.create_dir(at, recursive=True)
        with system.open_output_stream(f"{at}/{INDEX}") as f:
            f.write(json.dumps({"files": names}).encode())
        if self.overwrite:
            for i in system.get_file_info(fs.FileSelector(at)):
                if i.base_name.endswith(".npy") and i.base_name not in set(names):
                    system.delete_file(i.path)

    def abort(self, messages: list[Written | None]) -> None:
        system, at = located(self.path)
        for m in messages:
            for f in m.files if m is not None else []:
                system.delete_file(f"{at}/{f}")


class MatrixSource(DataSource):
    """`npy`: rows (row, values) of a .npy file or a folder of them. Options: rows (of a read partition or a written file), column and dtype (of a write)."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        found = matrices(self.options["path"])
        if not found:
            raise ValueError(f"{self.options['path']}: no matrix there")
        if len({(m.width, m.dtype) for m in found}) > 1:
            raise ValueError(f"{self.options['path']}: matrices of different widths or types")
        return f"row long, values array<{SQL_TYPES[found[0].dtype]}>"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options["path"], int(self.options.get("rows", ROWS_READ)))

    def writer(self, schema, overwrite: bool) -> MatrixWriter:
        arrays = [f.name for f in schema.fields if f.dataType.typeName() == "array"]
        column = self.options.get("column", arrays[0] if arrays else "")
        if column not in arrays:
            raise ValueError(f"no array column {column!r}")
        return MatrixWriter(self.options["path"], column, self.options.get("dtype", "<f4"), overwrite, int(self.options.get("rows", ROWS_WRITTEN)))


def register(spark: SparkSession) -> None:
    """Makes format("npy") known to the session."""
    spark.dataSource.register(MatrixSource)


def write_bank(df: DataFrame, path: str, key: str, column: str, dtype: str = "<f4") -> None:
    """A matrix and its metadata, row by row: `path`/matrix in order of `key`, and `path`/rows.parquet with `row` beside all other columns.

    Numbered rows are dealt by ranges of their number, so that the tasks' files follow each other in its order (the numbering itself
    leaves ranges in any order); the key names every row once.
    """
    register(df.sparkSession)
    rows = numbered(df, [F.asc(key)], "_number").withColumn("row", F.col("_number") - 1).drop("_number")
    rows.select("row", column).repartitionByRange("row").sortWithinPartitions("row").write.format("npy").mode("overwrite").options(path=f"{path}/matrix", column=column, dtype=dtype).save()
    rows.drop(column).write.mode("overwrite").parquet(f"{path}/rows.parquet")


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    """The metadata of a bank with each row's `values`."""
    register(spark)
    return spark.read.parquet(f"{path}/rows.parquet").join(spark.read.format("npy").load(f"{path}/matrix"), "row")


def write_pack(df: DataFrame, path: str, key: str, frames: str, dtype: str = "<f4") -> None:
    """The frames (array of equally long arrays) of all rows, one after another in order of `key`, as one matrix, and where each row's frames are.

    `path`/places.parquet holds (key, first, count); rows without frames have count 0. Frames are dealt by ranges of their place, as in write_bank.
    """
    from tessera.operators.profile import running_sums

    register(df.sparkSession)
    counted = df.select(key, F.col(frames).alias("_f"), F.coalesce(F.size(frames), F.lit(0)).cast("long").alias("count"))
    placed = running_sums(counted.withColumn("count", F.greatest("count", F.lit(0))), [F.asc(key)], {"first": "count"}, earlier=True)
    frame = placed.select("first", F.posexplode("_f").alias("_i", "values")).select((F.col("first") + F.col("_i")).alias("at"), "values")
    frame.repartitionByRange("at").sortWithinPartitions("at").select("values").write.format("npy").mode("overwrite").options(path=f"{path}/matrix", column="values", dtype=dtype).save()
    placed.select(key, F.col("first").cast("long").alias("first"), "count").write.mode("overwrite").parquet(f"{path}/places.parquet")


def packed(path: str, first: Column, count: Column) -> Column:
    """The frames first .. first + count of a pack as an array of arrays: each row reads its own bytes and no others.

    The index of the pack's files, a row for each file, travels with the function.
    """
    files = matrices(f"{path}/matrix")
    ends = np.cumsum([m.rows for m in files])

    @F.arrow_udf("array<array<float>>")
    def frames(first: pa.Array, count: pa.Array) -> pa.Array:
        out = []
        for a, n in zip(first.to_pylist(), count.to_pylist(), strict=True):
            rows = []
            while n:
                i = int(np.searchsorted(ends, a, side="right"))
                start = a - (int(ends[i - 1]) if i else 0)
                take = min(n, files[i].rows - start)
                rows += read_rows(files[i], start, take).astype(np.float32).tolist()
                a, n = a + take, n - take
            out.append(rows)
        return pa.array(out, pa.list_(pa.list_(pa.float32())))

    return frames(first, count)


def read_pack(spark: SparkSession, path: str, wanted: DataFrame | None = None, key: str = "id") -> DataFrame:
    """(key, frames) of a pack, or of the keys of `wanted`; only the bytes of these are read."""
    places = spark.read.parquet(f"{path}/places.parquet")
    if wanted is not None:
        places = places.join(wanted.select(key).distinct(), key, "left_semi")
    return places.select(key, packed(path, F.col("first"), F.col("count")).alias("frames"))
