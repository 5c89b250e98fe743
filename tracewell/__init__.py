"""Text, retrieval and trace analytics as Spark DataFrame operators."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, whatever their working folder is.

    A task has one core, so a worker's matrix products take one thread; more of them would wait for each other.
    """
    root = str(Path(__file__).resolve().parents[1])
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
    environment.setdefault("OPENBLAS_NUM_THREADS", "1")
