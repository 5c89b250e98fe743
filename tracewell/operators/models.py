"""Models on pyspark.ml: probes, out-of-fold predictions, residualization, clustering and partial correlation.

Scaling uses the population deviation and class weights are n / (classes * n of
the class), by hand, as pyspark.ml's own scaler divides by the sample deviation.
A penalty C of the usual libraries is regParam = 1 / (C * n).
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import LinearRegression
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Scaler:
    """Median imputation and scaling, fitted on one table and applied to others; constant columns become 0."""

    def __init__(self, train: DataFrame, columns: list[str]):
        self.columns = columns
        found = train.agg(*(F.percentile(c, 0.5).alias(f"m{i}") for i, c in enumerate(columns))).first()
        self.medians = [float(m) if m is not None else 0.0 for m in found]
        filled = self._filled(train)
        moments = filled.agg(*(f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("a", F.avg), ("s", F.stddev_pop)))).first()
        self.moments = [(float(moments[f"a{i}"] or 0.0), float(moments[f"s{i}"] or 0.0)) for i in range(len(columns))]

    def _filled(self, df: DataFrame) -> DataFrame:
        values = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(m)) for c, m in zip(self.columns, self.medians, strict=True)}
        return df.withColumns(values)

    def apply(self, df: DataFrame, out: str = "features") -> DataFrame:
        scaled = {c: (F.col(c) - a) / s if s > 0 else F.lit(0.0) for c, (a, s) in zip(self.columns, self.moments, strict=True)}
        return VectorAssembler(inputCols=self.columns, outputCol=out).transform(self._filled(df).withColumns(scaled))


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    counts = df.groupBy(label).agg(F.count("*").alias("__n"))
    whole = counts.agg(F.sum("__n").alias("__all"), F.count("*").alias("__k"))
    # A row per class; the rows of df stay where they are.
    return df.join(F.broadcast(counts.crossJoin(whole).select(label, (F.col("__all") / (F.col("__k") * F.col("__n"))).alias(out))), label)


def logistic(train: DataFrame, label: str, features: str = "features", c: float = 1.0, weight: str | None = None, multinomial: bool = False):
    options = {"weightCol": weight} if weight else {}
    n = max(1, train.count())
    return LogisticRegression(labelCol=label, featuresCol=features, regParam=1 / (c * n), elasticNetParam=0.0, maxIter=100, standardization=False, family="multinomial" if multinomial else "auto", **options).fit(train)


def boosted_trees(train: DataFrame, label: str, features: str = "features", trees: int = 30, depth: int = 4, rate: float = 0.05, seed: int = 42):
    """Boosted trees; they grow by depth, so results differ from leaf-wise libraries."""
    return GBTClassifier(labelCol=label, featuresCol=features, maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed).fit(train)


def residualize(train: DataFrame, test: DataFrame, columns: list[str], controls: list[str]) -> DataFrame:
    """The test rows' columns minus their least-squares prediction from the controls, fitted on the train rows."""
    assemble = VectorAssembler(inputCols=controls, outputCol="__controls")
    fitted, out = assemble.transform(train), assemble.transform(test)
    for c in columns:
        model = LinearRegression(labelCol=c, featuresCol="__controls", regParam=0.0, predictionCol="__predicted").fit(fitted)
        out = model.transform(out).withColumn(c, F.col(c) - F.col("__predicted")).drop("__predicted")
    return out.drop("__controls")


def out_of_fold(df: DataFrame, id_col: str, label: str, columns: list[str], fold: str = "fold", fit: Callable | None = None, controls: list[str] | None = None) -> DataFrame:
    """id, fold, label and the probability that a model of the other folds gives; scaling and controls are fitted there too."""
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    parts = []
    for k in folds:
        train, test = df.where(F.col(fold) != k), df.where(F.col(fold) == k)
        if controls:
            train, test = residualize(train, train, columns, controls), residualize(train, test, columns, controls)
        scaler = Scaler(train, columns)
        ready = balanced_weights(scaler.apply(train), label)
        model = fit(ready) if fit else logistic(ready, label, weight="weight")
        parts.append(model.transform(scaler.apply(test)).select(id_col, fold, label, vector_to_array("probability")[1].alias("prob")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def probe(train: DataFrame, test: DataFrame, label: str, vector: str, cs: tuple[float, ...] = (0.01, 0.1, 1.0)) -> DataFrame:
    """Predictions of a multinomial probe whose C does best, by macro-F1, on a fifth of the training rows kept apart."""
    from .statistics import averaged_metrics, class_metrics

    as_vector = lambda d: d.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    held = F.pmod(F.xxhash64(F.col(vector)), F.lit(5)) == 0
    inner, valid = as_vector(train.where(~held)), as_vector(train.where(held))
    scores = {}
    for c in cs:
        guessed = logistic(inner, label, c=c, multinomial=True).transform(valid).select(F.col(label).cast("int").alias("t"), F.col("prediction").cast("int").alias("p"))
        scores[c] = averaged_metrics(class_metrics(guessed, "t", "p")).first()["macro_f1"] or 0.0
    best = max(cs, key=lambda c: (scores[c], -c))
    return logistic(as_vector(train), label, c=best, multinomial=True).transform(as_vector(test)).withColumn("c", F.lit(best)).drop("features", "rawPrediction")


def swept_probe(train: DataFrame, valid: DataFrame, test: DataFrame, label: str, vector: str, cs: tuple[float, ...], fit: Callable | None = None) -> tuple[DataFrame, float]:
    """Predictions on the test rows, and the C that does best by macro-F1 on rows given for that; the first of equal ones.

    ``vector`` names a column of arrays or of vectors; vectors with few values stay so.
    """
    from .statistics import averaged_metrics, class_metrics

    fit = fit or (lambda rows, c: logistic(rows, label, c=c, multinomial=True))
    ready_made = isinstance(train.schema[vector].dataType, VectorUDT)
    as_vector = lambda d: d.withColumn("features", F.col(vector) if ready_made else array_to_vector(F.col(vector).cast("array<double>")))
    ready, scores = as_vector(train).persist(), {}
    try:
        ready.count()
        with ThreadPoolExecutor(4) as pool:
            models = dict(zip(cs, pool.map(lambda c: fit(ready, c), cs), strict=True))
        for c in cs if len(cs) > 1 else ():
            guessed = models[c].transform(as_vector(valid)).select(F.col(label).cast("int").alias("t"), F.col("prediction").cast("int").alias("p"))
            scores[c] = averaged_metrics(class_metrics(guessed, "t", "p")).first()["macro_f1"] or 0.0
    finally:
        ready.unpersist()
    best = max(cs, key=lambda c: scores.get(c, 0.0))
    return models[best].transform(as_vector(test)), best


def clusters(df: DataFrame, columns: list[str], ks: tuple[int, ...] = (2, 3, 4), seed: int = 42) -> tuple[DataFrame, int]:
    """Rows with the cluster of the k of best silhouette, and that k."""
    ready = Scaler(df, columns).apply(df)
    best = None
    for k in ks:
        out = KMeans(k=k, seed=seed).fit(ready).transform(ready)
        score = ClusteringEvaluator().evaluate(out)
        if best is None or score > best[0]:
            best = (score, k, out)
    return best[2].withColumnRenamed("prediction", "cluster").drop("features"), best[1]


def explained_variance(df: DataFrame, vector: str, k: int) -> list[float]:
    """Shares of variance of the first k principal components."""
    return [float(v) for v in PCA(k=k, inputCol="v", outputCol="p").fit(df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("v"))).explainedVariance]


def partial_spearman(df: DataFrame, group: str, x: str, y: str, controls: list[str]) -> DataFrame:
    """Spearman correlation of x and y per group with the ranks of the controls taken out of both; NULL where a side is constant or rows are few."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        full = frame[[x, y, *controls]].dropna()
        rho = None
        if len(full) >= len(controls) + 3:
            ranks = full.rank().to_numpy(float)
            design = np.column_stack([np.ones(len(full)), ranks[:, 2:]])
            rest = [ranks[:, i] - design @ np.linalg.lstsq(design, ranks[:, i], rcond=None)[0] for i in (0, 1)]
            again = [pd.Series(r.round(9)).rank().to_numpy() for r in rest]
            if all(a.std() > 0 for a in again):
                rho = float(np.corrcoef(again[0], again[1])[0, 1])
        return pd.DataFrame({group: [frame[group].iloc[0]], "n": [len(full)], "rho": [rho]})

    kind = dict(df.dtypes)[group]
    return df.select(group, x, y, *controls).groupBy(group).applyInPandas(run, f"{group} {kind}, n bigint, rho double")


def majority_baseline(df: DataFrame, label: str) -> DataFrame:
    """Accuracy of always guessing the most frequent label."""
    top = df.groupBy(label).agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(Window.orderBy(F.col("n").desc(), label)))
    return top.agg(F.max(F.when(F.col("r") == 1, F.col(label))).alias("guess"), (F.max(F.when(F.col("r") == 1, F.col("n"))) / F.sum("n")).alias("accuracy"))


def linear_svm(train: DataFrame, label: str, features: str = "features", c: float = 1.0):
    """A linear machine with hinge loss per class against the rest; the class of the largest margin is predicted."""
    n = max(1, train.count())
    one = LinearSVC(regParam=1 / (c * n), maxIter=100, standardization=False)
    return OneVsRest(classifier=one, labelCol=label, featuresCol=features, parallelism=4).fit(train)


#: Kinds of linear probes by name: (rows with features, label, C) -> model.
LINEAR_PROBES = {
    "logistic": lambda rows, label, c: logistic(rows, label, c=c, multinomial=True),
    "svm": lambda rows, label, c: linear_svm(rows, label, c=c),
}


def least_squares(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """Rows (term, coefficient, r2, n) of an ordinary regression with intercept; rows with a missing value don't count.

    Columns must not depend on each other linearly, so a set of dummies lacks one category.
    """
    from .gram import ridge

    full = df.select(F.col(target).cast("double").alias("__y"), *(F.col(c).cast("double").alias(c) for c in columns)).dropna()
    model = ridge(full.select(F.array(*columns).alias("x"), F.array("__y").alias("y")), "x", "y", 0.0)
    guess = sum((F.col(c) * float(w) for c, w in zip(columns, model.weights[:, 0], strict=True)), F.lit(float(model.intercept[0])))
    fit = full.agg(F.count("*").alias("n"), F.sum((F.col("__y") - guess) ** 2).alias("rest"), F.var_pop("__y").alias("v")).first()
    r2 = 1 - fit["rest"] / (fit["v"] * fit["n"]) if fit["v"] else None
    rows = [("intercept", float(model.intercept[0]), r2, fit["n"]), *((c, float(w), r2, fit["n"]) for c, w in zip(columns, model.weights[:, 0], strict=True))]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double, r2 double, n bigint")
