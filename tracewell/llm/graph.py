"""Connected components of a graph that only exists as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work

#: Parts that a node's neighbours are dealt into.
SALTS = 16


def components(edges: DataFrame, folder: str) -> DataFrame:
    """Rows (node, component) of all nodes of an undirected edge table (u, v); component is the smallest node.

    Alternates large-star and small-star steps: each hangs neighbours below the smallest one they know
    of, so paths shorten until every component is a star.  Each round is a written table.  A hub's neighbours
    are dealt into ``SALTS`` parts, which are aggregated and joined apart, so that no task takes them all.
    """
    spark = edges.sparkSession
    now = work.materialize(edges.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{folder}/edges-0")
    state = _state(now)
    step = 0
    while state[0]:
        step += 1
        both = now.union(now.select("v", "u")).toDF("u", "v").withColumn("part", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
        parts = both.groupBy("u", "part").agg(F.min("v").alias("m"))
        smallest = parts.groupBy("u").agg(F.least(F.min("m"), F.first("u")).alias("m"), F.collect_set("part").alias("parts"))
        large = both.where("v > u").join(smallest.select("u", F.explode("parts").alias("part"), "m"), ["u", "part"]).select(F.col("m").alias("u"), "v").where("u != v").distinct()
        below = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(below, "v").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u != v").distinct()
        now = work.materialize(small, f"{folder}/edges-{step}")
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return spark.read.schema(now.schema).parquet(f"{folder}/edges-{step}").select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    """Count and checksum of an edge table; equal from one round to the next only when nothing changed."""
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
