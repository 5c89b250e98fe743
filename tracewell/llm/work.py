"""Shared working storage and the small conventions all operators here follow.

* Intermediate tables and block files live under ``spark.checkpoint.dir``,
  which every executor and the driver can reach.  Only where that setting is
  missing and the session is local (tests, a laptop) a temporary folder is used.
* A written table cuts lineage: after :func:`materialize` a lost executor costs
  a re-read, not a recomputation.
* Files written by tasks carry a fresh random name and become visible through
  a manifest row only.  Manifests are committed by Spark's own writer, so a
  retried or speculative attempt can leave an orphan file but never a second
  manifest row.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .. import on_workers

_LOCAL_ROOT: list[str] = []

#: Rows of an Arrow batch sent to Python.  Rows hold whole documents, so the
#: engine default of 10,000 would put tens of megabytes into one batch.
BATCH_ROWS = 500


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or a local one where all of them are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append("file://" + tempfile.mkdtemp(prefix="tracewell-"))
    return _LOCAL_ROOT[0]


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder URI for one run of one operator; also readies the session for the operator's Python tasks."""
    on_workers(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, uri: str) -> DataFrame:
    """Write df as Parquet and read it back; the result has no lineage beyond the files."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def parallelism(spark: SparkSession) -> int:
    """Partitions for a shuffle by key, as the session is set."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_file(uri: str, *chunks: bytes) -> None:
    """Write a new file in shared storage (local, HDFS, S3 and GCS URIs)."""
    system, path = _filesystem(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)


def read_file(uri: str, offset: int = 0, size: int | None = None) -> bytes:
    """Read a whole file, or ``size`` bytes from ``offset``."""
    system, path = _filesystem(uri)
    with system.open_input_file(path) as source:
        if offset == 0 and size is None:
            return source.read()
        return source.read_at(size if size is not None else source.size() - offset, offset)


def remove(spark: SparkSession, uri: str) -> None:
    """Remove a working folder that no later step reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def open_file(uri: str):
    """Random-access handle of a file in shared storage."""
    system, path = _filesystem(uri)
    return system.open_input_file(path)


def fresh_name(prefix: str = "part") -> str:
    return f"{prefix}-{uuid.uuid4().hex}"


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
