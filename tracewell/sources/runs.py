"""Datasets by name, run folders by slug, and stages that are skipped when their output exists."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession


class DatasetRegistry:
    """name -> how to make traces, score results and label slices."""

    def __init__(self) -> None:
        self._entries: dict[str, dict[str, Callable]] = {}

    def register(self, name: str, *, produce: Callable[..., DataFrame], score: Callable[[DataFrame], DataFrame] | None = None, slice_label: Callable[[], Column] | None = None) -> None:
        self._entries[name] = {"produce": produce, "score": score, "slice_label": slice_label}

    def _of(self, name: str, what: str) -> Callable:
        if name not in self._entries:
            raise KeyError(f"unknown dataset {name!r}; known are {sorted(self._entries)}")
        found = self._entries[name][what]
        if found is None:
            raise NotImplementedError(f"{name} has no {what}")
        return found

    def produce(self, name: str, *args, **options) -> DataFrame:
        return self._of(name, "produce")(*args, **options)

    def score(self, name: str, results: DataFrame) -> DataFrame:
        return self._of(name, "score")(results)

    def slice_label(self, name: str) -> Column:
        return self._of(name, "slice_label")()


def resolve_run(folder: str, slug: str) -> str:
    """The run folder of that name, else the only one whose name begins with it."""
    runs = sorted(p.name for p in Path(folder).iterdir() if p.is_dir())
    found = [slug] if slug in runs else [r for r in runs if r.startswith(slug)]
    if len(found) != 1:
        raise FileNotFoundError(f"{'no run' if not found else 'several runs'} for {slug!r}: {found or runs}")
    return str(Path(folder) / found[0])


def stage_output(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; made and written only if it isn't there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
