"""Archives of arrays (zip files of .npy members) as a data source.

    spark.dataSource.register(ArraySource)
    spark.read.format("arrays").load("/data/level.npz")
    df.write.format("arrays").mode("overwrite").save("/data/level")

A row of the table is a place along the first axis of the members: a member of
one axis is a column of numbers, truth values or strings, one of two axes a
column of arrays.  The path is an archive or a folder of archives.  Planning
reads the zip directories and the members' headers only; tasks read their own
rows, by offset, of members that are stored as they are (which is usual), and
decompress up to their rows where a member is deflated.

Writing gives an archive per task.  They get their final names when all tasks
are done, so a retried task leaves no double rows.  Null arrays and numbers
can't be stored and are an error; null strings are stored as empty ones.
"""

from __future__ import annotations

import io
import struct
import uuid
import zipfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows that a task reads, and rows of an Arrow batch.
TASK_ROWS, BATCH_ROWS = 50_000, 2_000


def _system(path: str):
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass(frozen=True)
class Member:
    """An array in an archive: where its data begin, its type and shape; ``offset`` is None if it is deflated."""

    name: str
    entry: str
    kind: str
    shape: tuple[int, ...]
    header: int
    offset: int | None

    @property
    def ddl(self) -> str:
        dtype = np.dtype(self.kind)
        names = {"i": {1: "byte", 2: "short", 4: "int", 8: "bigint"}, "u": {1: "short", 2: "int", 4: "bigint"}, "f": {2: "float", 4: "float", 8: "double"}, "b": {1: "boolean"}}
        name = "string" if dtype.kind in "US" else names.get(dtype.kind, {}).get(dtype.itemsize)
        if name is None or len(self.shape) not in (1, 2):
            raise ValueError(f"member {self.name} of type {self.kind} and shape {self.shape} has no column type")
        return f"`{self.name}` " + (name if len(self.shape) == 1 else f"array<{name}>")


def members(source) -> list[Member]:
    """The arrays of an open archive, from its directory and their headers."""
    out = []
    with zipfile.ZipFile(source) as archive:
        for info in archive.infolist():
            if not info.filename.endswith(".npy"):
                continue
            with archive.open(info) as data:
                version = np.lib.format.read_magic(data)
                read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
                shape, fortran, dtype = read(data)
                if fortran and len(shape) > 1 or dtype.hasobject:
                    raise ValueError(f"member {info.filename} is not in row order or holds objects")
                header = data.tell()
            offset = None
            if info.compress_type == zipfile.ZIP_STORED:
                source.seek(info.header_offset)
                name, extra = struct.unpack("<HH", source.read(30)[26:])
                offset = info.header_offset + 30 + name + extra + header
            out.append(Member(info.filename[: -len(".npy")], info.filename, dtype.str, tuple(shape), header, offset))
    return out


@dataclass
class Rows(InputPartition):
    path: str
    start: int
    stop: int


def _archives(path: str) -> list[str]:
    system, at = _system(path)
    if system.get_file_info(at).type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(at))
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    names = sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".npz"))
    if not names:
        raise FileNotFoundError(f"no archive in {path}")
    return [prefix + n for n in names]


def _opened(path: str):
    system, at = _system(path)
    return system.open_input_file(at)


def _aligned(found: list[Member], path: str) -> int:
    sizes = {m.shape[0] for m in found}
    if len(sizes) != 1:
        raise ValueError(f"members of {path} have {sorted(sizes)} rows")
    return sizes.pop()


def _part(source, member: Member, start: int, stop: int) -> np.ndarray:
    dtype = np.dtype(member.kind)
    width = dtype.itemsize * int(np.prod(member.shape[1:], dtype=int))
    if member.offset is not None:
        source.seek(member.offset + start * width)
        data = source.read((stop - start) * width)
    else:
        with zipfile.ZipFile(source) as archive, archive.open(member.entry) as packed:
            packed.seek(member.header + start * width)
            data = packed.read((stop - start) * width)
    return np.frombuffer(data, dtype).reshape(stop - start, *member.shape[1:])


def _column(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    item = kind.value_type if pa.types.is_list(kind) else kind
    flat = values.ravel()
    flat = pa.array(flat.astype(str).tolist(), pa.string()) if pa.types.is_string(item) else pa.array(flat.astype(item.to_pandas_dtype()))
    if not pa.types.is_list(kind):
        return flat
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), flat)


class ArrayReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, task_rows: int):
        self.schema, self.path, self.task_rows = schema, path, task_rows

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in _archives(self.path):
            with _opened(path) as source:
                n = _aligned(members(source), path)
            out += [Rows(path, at, min(n, at + self.task_rows)) for at in range(0, n, self.task_rows)]
        return out or [Rows("", 0, 0)]

    def read(self, partition: Rows):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        if not partition.path:
            return
        with _opened(partition.path) as source:
            found = {m.name: m for m in members(source)}
            for start in range(partition.start, partition.stop, BATCH_ROWS):
                stop = min(partition.stop, start + BATCH_ROWS)
                columns = [_column(_part(source, found[f.name], start, stop), f.type).cast(f.type) for f in schema]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class ArrayWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator) -> Written:
        batches = [b for b in iterator if b.num_rows]
        if not batches:
            return Written(None)
        table = pa.Table.from_batches(batches).combine_chunks()
        arrays = {}
        for name, column in zip(table.column_names, table.columns, strict=True):
            column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            if pa.types.is_string(column.type):
                arrays[name] = np.array([v or "" for v in column.to_pylist()], dtype=str)
            elif pa.types.is_list(column.type):
                sizes = np.diff(column.offsets.to_numpy())
                if column.null_count or len(set(sizes.tolist())) > 1 or column.flatten().null_count:
                    raise ValueError(f"column {name} has nulls or arrays of different lengths")
                arrays[name] = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
            else:
                if column.null_count:
                    raise ValueError(f"column {name} has nulls")
                arrays[name] = column.to_numpy(zero_copy_only=False)
        whole = io.BytesIO()
        np.savez(whole, **arrays)
        system, at = _system(self.path)
        name = f"{uuid.uuid4().hex}.npz"
        system.create_dir(f"{at}/_parts", recursive=True)
        with system.open_output_stream(f"{at}/_parts/{name}", compression=None) as out:
            out.write(whole.getbuffer())
        return Written(name)

    def commit(self, messages) -> None:
        system, at = _system(self.path)
        system.create_dir(f"{at}/_parts", recursive=True)
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(at)):
                if old.type == fs.FileType.File and old.path.endswith(".npz"):
                    system.delete_file(old.path)
        for name in sorted(m.name for m in messages if m and m.name):
            system.move(f"{at}/_parts/{name}", f"{at}/{name}")
        system.delete_dir(f"{at}/_parts")

    def abort(self, messages) -> None:
        system, at = _system(self.path)
        for m in messages:
            if m and m.name:
                system.delete_file(f"{at}/_parts/{m.name}")


class ArraySource(DataSource):
    """Options: path, and taskRows for the rows that one task reads."""

    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> str:
        path = _archives(self.options["path"])[0]
        with _opened(path) as source:
            return ", ".join(m.ddl for m in members(source))

    def reader(self, schema: StructType) -> ArrayReader:
        return ArrayReader(schema, self.options["path"], int(self.options.get("taskRows", TASK_ROWS)))

    def writer(self, schema: StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options["path"], overwrite)


def read_arrays(spark: SparkSession, path: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """The rows of an archive or of a folder of archives."""
    spark.dataSource.register(ArraySource)
    return spark.read.format("arrays").option("taskRows", task_rows).load(path)


def write_arrays(df: DataFrame, path: str) -> None:
    """Replace the archives of a folder by the rows of df, an archive per task."""
    df.sparkSession.dataSource.register(ArraySource)
    df.write.format("arrays").mode("overwrite").save(path)


def level_lookup(rows: DataFrame, levels: DataFrame, key: str) -> DataFrame:
    """The rows of an index that belong to each group of ``levels``, by an equi-join on the key."""
    return levels.join(rows, key)
