"""Level axes in an embedding space, projections, and the geometry of traces of vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


def centroids(df: DataFrame, label: str, vector: str) -> dict:
    """Mean vector per label: averaged per (label, dimension) in Spark; what is collected has labels x dimensions numbers."""
    rows = df.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m")).collect()
    out: dict = {}
    for key, i, m in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        out.setdefault(key, []).append(m)
    return {k: np.array(v) for k, v in out.items()}


def centroid_axis(df: DataFrame, label: str, vector: str, low, high) -> np.ndarray:
    """Unit vector from the centroid of one label to that of another; ValueError if they coincide."""
    found = centroids(df.where(F.col(label).isin(low, high)), label, vector)
    axis = found[high] - found[low]
    size = np.linalg.norm(axis)
    if size < 1e-10:
        raise ValueError("the centroids coincide")
    return axis / size


def discriminant_axis(df: DataFrame, label: str, vector: str, low, high, ridge: float = 1e-6) -> np.ndarray:
    """Unit vector of the linear discriminant of two labels, pointing from low to high.

    The within-class scatter is summed per pair of dimensions in Spark; it has dimensions squared numbers.
    """
    two = df.where(F.col(label).isin(low, high))
    means = centroids(two, label, vector)
    size = len(means[low])
    grid = two.select(label, F.posexplode(vector).alias("i", "x"), F.col(vector).alias("__v"))
    moments = grid.select(label, "i", "x", F.posexplode("__v").alias("j", "y")).groupBy(label, "i", "j").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("double") * F.col("y").cast("double")).alias("s")).collect()
    scatter = np.eye(size) * ridge
    for key, i, j, n, s in moments:
        scatter[i, j] += s - n * means[key][i] * means[key][j]
    axis = np.linalg.solve(scatter, means[high] - means[low])
    axis = axis / np.linalg.norm(axis)
    return axis if axis @ (means[high] - means[low]) >= 0 else -axis


def project(vector: Column, axis: np.ndarray) -> Column:
    return V.dot(vector, F.array(*(F.lit(float(a)) for a in axis)))


def axis_cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine of two axes; 0 if one is zero."""
    size = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / size) if size else 0.0


def validate_axis(df: DataFrame, label: str, projection: str, low, middle, high) -> DataFrame:
    """n, mean and deviation per label, Cohen's d of high and low by the pooled deviation, and whether the means are in order."""
    per = df.groupBy(label).agg(F.count("*").alias("n"), F.avg(projection).alias("mean"), F.stddev_pop(projection).alias("std"))
    of = lambda c, k: F.max(F.when(F.col(label) == k, c))
    whole = per.agg(*(of(F.col("mean"), k).alias(f"__m{i}") for i, k in enumerate((low, middle, high))), of(F.col("std"), low).alias("__s0"), of(F.col("std"), high).alias("__s2"))
    pooled = F.sqrt((F.col("__s0") * F.col("__s0") + F.col("__s2") * F.col("__s2")) / 2)
    d = F.when(pooled > 0, (F.col("__m2") - F.col("__m0")) / pooled)
    ordered = (F.col("__m0") < F.col("__m1")) & (F.col("__m1") < F.col("__m2"))
    return per.crossJoin(F.broadcast(whole)).select(label, "n", "mean", "std", d.alias("cohens_d"), ordered.alias("ordered"))


def path_features(df: DataFrame, trace: str, order: str, vector: str) -> DataFrame:
    """Steps, mean, largest and summed cosine distance of successive vectors, displacement and efficiency; NULL for one step."""
    w = Window.partitionBy(trace).orderBy(order)
    steps = df.select(trace, order, V.cosine_distance(F.col(vector), F.lag(vector).over(w)).alias("d"), F.lag(vector).over(w).isNotNull().alias("__has"), V.cosine_distance(F.col(vector), F.first(vector).over(w)).alias("far"))
    d = F.when(F.col("__has"), F.col("d"))
    sums = steps.groupBy(trace).agg(F.count("*").alias("n_steps"), F.avg(d).alias("mean_cosine_dist"), F.max(d).alias("max_cosine_dist"), F.sum(d).alias("path_length"), F.max_by("far", order).alias("displacement"))
    return sums.withColumn("path_efficiency", F.when(F.col("path_length") > 1e-10, F.col("displacement") / F.col("path_length")))


def axis_features(df: DataFrame, trace: str, order: str, vector: str, axis: np.ndarray) -> DataFrame:
    """Projection mean, variance, range, drift, direction and monotonicity (Spearman with the step), and the drift orthogonal to the axis.

    What needs two steps is NULL for one; the ratio is NULL where nothing moves.
    """
    from .statistics import average_rank

    w = Window.partitionBy(trace).orderBy(order)
    steps = df.select(trace, order, F.col(vector).alias("__v"), project(F.col(vector), axis).alias("__p"), F.row_number().over(w).alias("__i"))
    before = F.lag("__v").over(w)
    moved = F.zip_with("__v", before, lambda a, b: a.cast("double") - b.cast("double"))
    drift = steps.select(trace, order, "__i", "__p", average_rank("__p", trace).alias("__r"), (F.col("__p") - F.lag("__p").over(w)).alias("__d"), F.when(before.isNotNull(), V.dot(moved, moved)).alias("__all"), (V.dot(F.col("__v"), F.col("__v")) - F.col("__p") * F.col("__p")).alias("__o2"))
    away = F.when(F.col("__d").isNotNull(), F.sqrt(F.greatest(F.lit(0.0), F.col("__all") - F.col("__d") * F.col("__d"))))
    out = drift.groupBy(trace).agg(
        F.count("*").alias("n_steps"), F.avg("__p").alias("axis_mean"), F.var_pop("__p").alias("axis_variance"), (F.max("__p") - F.min("__p")).alias("axis_range"),
        F.avg(F.abs("__d")).alias("axis_drift_mean"), F.max(F.abs("__d")).alias("axis_drift_max"), F.signum(F.max_by("__p", "__i") - F.min_by("__p", "__i")).alias("axis_direction"),
        F.corr("__i", "__r").alias("__rho"), F.avg(away).alias("orthogonal_drift_mean"), F.avg(F.sqrt("__all")).alias("__moved"),
    )
    several = F.col("n_steps") > 1
    monotone = F.when(F.col("n_steps") > 2, F.coalesce(F.nanvl("__rho", F.lit(0.0)), F.lit(0.0))).when(several, F.col("axis_direction"))
    return out.withColumn("axis_direction", F.when(several, F.col("axis_direction"))).withColumn("axis_monotonicity", monotone).withColumn("axis_ratio", F.when(F.col("__moved") > 1e-10, F.col("axis_drift_mean") / F.col("__moved"))).drop("__rho", "__moved")


def layer_differences(df: DataFrame, layer: str, label: str, vector: str, low, high) -> DataFrame:
    """Per layer the length of the difference of the two classes' mean vectors, and whether it is the largest."""
    parts = df.where(F.col(label).isin(low, high)).select(layer, label, F.posexplode(vector).alias("i", "x"))
    means = parts.groupBy(layer, "i").agg((F.avg(F.when(F.col(label) == high, F.col("x").cast("double"))) - F.avg(F.when(F.col(label) == low, F.col("x").cast("double")))).alias("d"))
    norms = means.groupBy(layer).agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("norm"))
    top = norms.agg(F.max("norm").alias("__top"))
    return norms.crossJoin(top).select(layer, "norm", (F.col("norm") == F.col("__top")).alias("largest"))
