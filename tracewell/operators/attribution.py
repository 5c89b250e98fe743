"""Which kind of failure a trace has: a classifier of several classes, out of fold, with a probability per class."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import stored
from .models import Scaler, balanced_weights, logistic
from .sampling import stratified_folds
from .statistics import auc, averaged_metrics, class_metrics

SUMMARY = "skipped boolean, reason string, n_items bigint, n_classes int, folds int, accuracy double, macro_f1 double, weighted_f1 double, macro_auc double"


@dataclass
class Types:
    """One row of summary, and the rows out of fold (None if skipped): id, fold, group, true_type, pred_type, correct, probs."""

    summary: DataFrame
    rows: DataFrame | None


def _skipped(spark: SparkSession, reason: str) -> Types:
    return Types(spark.createDataFrame([(True, reason, None, None, None, None, None, None, None)], SUMMARY), None)


def macro_auc(rows: DataFrame, truth: str, probs: str) -> DataFrame:
    """Mean over the classes of the AUC of a class against the rest; classes without both sides don't count."""
    long = rows.select(F.col(truth).alias("__t"), F.explode(probs).alias("class", "p")).select("class", (F.col("__t") == F.col("class")).cast("int").alias("y"), "p")
    return auc(long, "y", "p", ["class"]).agg(F.avg("auc").alias("macro_auc"))


def failure_types(df: DataFrame, key: str, type_col: str, columns: list[str], group: str | None = None, folds: int = 5, least: int = 10) -> Types:
    """Classify the rows' types from their columns; types of fewer than ``least`` rows are left out.

    Empty types and the words none and nan are no types.  Too few types or rows give a summary with the reason.
    """
    spark = df.sparkSession
    named = df.withColumn("__type", F.trim(F.col(type_col).cast("string"))).where(~F.lower("__type").isin("", "none", "nan"))
    counts = {r["__type"]: r["n"] for r in named.groupBy("__type").agg(F.count("*").alias("n")).collect()}  # a row per type
    kept = sorted(t for t, n in counts.items() if n >= least)
    if not counts:
        return _skipped(spark, f"no row has a {type_col}")
    if len(kept) < 2:
        return _skipped(spark, f"fewer than two types have {least} rows: {dict(sorted(counts.items()))}")
    k = min(folds, min(counts[t] for t in kept))
    if k < 2:
        return _skipped(spark, "a type has one row only")
    number = F.create_map(*(F.lit(v) for i, t in enumerate(kept) for v in (t, i)))
    rows = stratified_folds(named.where(F.col("__type").isin(kept)), "__type", key, k).withColumn("__label", number[F.col("__type")].cast("int"))

    def one(f: int) -> DataFrame:
        train, test = rows.where(F.col("fold") != f), rows.where(F.col("fold") == f)
        scaler = Scaler(train, columns)
        ready = balanced_weights(scaler.apply(train), "__label").persist()
        try:
            model = logistic(ready, "__label", weight="weight", multinomial=True)
        finally:
            ready.unpersist()
        probs = vector_to_array("probability")
        predicted = F.element_at(F.array(*(F.lit(t) for t in kept)), F.col("prediction").cast("int") + 1)
        return model.transform(scaler.apply(test)).select(
            F.col(key).alias("id"), "fold", (F.col(group) if group else F.lit("unknown")).cast("string").alias("group"), F.col("__type").alias("true_type"), predicted.alias("pred_type"),
            F.map_from_arrays(F.array(*(F.lit(t) for t in kept)), probs).alias("probs"),
        )

    with ThreadPoolExecutor(4) as pool:
        parts = list(pool.map(one, range(k)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = stored(out.withColumn("correct", (F.col("true_type") == F.col("pred_type")).cast("int")), "failure_types")
    sums = out.agg(F.count("*").alias("n_items"), F.avg("correct").alias("accuracy"))
    averages = averaged_metrics(class_metrics(out, "true_type", "pred_type"))
    head = sums.crossJoin(averages).crossJoin(macro_auc(out, "true_type", "probs"))  # one row each
    fixed = {"skipped": F.lit(False), "reason": F.lit(None).cast("string"), "n_classes": F.lit(len(kept)), "folds": F.lit(k)}
    return Types(head.withColumns(fixed).select("skipped", "reason", "n_items", "n_classes", "folds", "accuracy", "macro_f1", "weighted_f1", "macro_auc"), out)
