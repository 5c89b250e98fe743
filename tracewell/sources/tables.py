"""Readers and writers: Parquet tables, JSON lines, JSON documents, CSV features, and file sets.

NaN never means missing in this engine: :func:`nan_to_null` turns it into NULL
where a source may hold it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StringType, StructType


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder; filters and columns are pushed into the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating-point columns becomes NULL."""
    kinds = (DoubleType, FloatType)
    return df.select(*(F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f.name) for f in df.schema))


def finite(df: DataFrame, columns: list[str], fill: float | None = None) -> DataFrame:
    """Only rows whose columns are all finite numbers; with ``fill``, all rows, with it in place of the other values."""
    ok = lambda c: F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False)) & ~F.isnan(c)
    if fill is not None:
        return df.withColumns({c: F.when(ok(c), F.col(c)).otherwise(F.lit(fill)) for c in columns})
    for c in columns:
        df = df.where(ok(c))
    return df


def read_jsonl(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """JSON lines; blank lines are skipped, and a line that doesn't parse gives a row of NULLs."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def read_json_document(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A file that is one JSON value, over several lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json_document(df: DataFrame, path: str) -> None:
    """One JSON array in one file, a line per row; the rows stream through one task and are never held together."""
    rows = df.coalesce(1).select(F.to_json(F.struct("*")).alias("row"), F.monotonically_increasing_id().alias("__i"))
    lines = rows.select(F.when(F.col("__i") == 0, F.concat(F.lit("["), "row")).otherwise(F.concat(F.lit(","), "row")).alias("value"))
    end = df.sparkSession.range(1).select(F.when(F.lit(df.isEmpty()), "[]").otherwise("]").alias("value"))
    lines.unionByName(end).coalesce(1).write.mode("overwrite").text(path)


def write_table(df: DataFrame, folder: str, name: str) -> None:
    """A Parquet table of a folder, as :func:`load_table` reads it."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def read_features(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header; empty and NaN cells are NULL."""
    return nan_to_null(spark.read.csv(path, header=True, schema=schema, nanValue="NaN"))


def write_features(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_many(spark: SparkSession, paths: list[str], schema: StructType, corrupt: str = "_corrupt_record", whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """JSON files below some folders: (good rows with their ``file``, unreadable records with theirs).

    Files hold JSON lines, or, with ``whole``, one value each over any lines: an object or an array of objects.
    Lines of large files are read in parallel; a whole file is one row, so such files must be small by nature.
    """
    full = StructType([*schema.fields]).add(corrupt, StringType())
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
    read = spark.read.option("recursiveFileLookup", True).text(paths, wholetext=whole)
    texts = read.select(F.input_file_name().alias("file"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("value")).where("value != ''")
    one = F.from_json("value", full, options)
    if whole:
        many = F.from_json("value", ArrayType(full), options)
        rows = texts.select("file", F.explode(F.when(F.col("value").startswith("["), F.coalesce(many, F.array(one))).otherwise(F.array(one))).alias("r")).select("r.*", "file")
    else:
        rows = texts.select(one.alias("r"), "file").select("r.*", "file")
    return rows.where(F.col(corrupt).isNull()).drop(corrupt), rows.where(F.col(corrupt).isNotNull()).select("file", corrupt)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share: below spark.checkpoint.dir, or a temporary one of a local session."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tracewell-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def latest_labels(labels: DataFrame, key: str, label: str, order: str, allowed: list[str]) -> DataFrame:
    """Of grouped relabelling batches the valid labels, where a later batch replaces an earlier one."""
    latest = Window.partitionBy(key).orderBy(F.col(order).desc(), F.col(label))
    return labels.where(F.col(label).isin(allowed)).withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n")


def publish(tables: dict[str, DataFrame], path: str) -> str:
    """Write some tables as folders of ``path`` so that readers see all of them or those of before, never a part."""
    spark = next(iter(tables.values())).sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path
    fresh, old = f"{path}.{uuid.uuid4().hex}", f"{path}.{uuid.uuid4().hex}.old"
    for name, table in tables.items():
        table.write.parquet(f"{fresh}/{name}")
    system = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(at(path).getParent())
    replaced = system.exists(at(path))
    if replaced:
        system.rename(at(path), at(old))
    if not system.rename(at(fresh), at(path)):
        raise OSError(f"could not publish {path}")
    if replaced:
        system.delete(at(old), True)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table as it is read back from shared storage, so that what follows doesn't compute it again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
