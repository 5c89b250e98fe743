"""Failure detectors over trajectory features: scores, thresholds, flags and their evaluation.

Target 1 is success.  The answer-side detectors of the original study were chosen
after looking at one of its datasets, so a "confirmed" verdict there is circular.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resampling import weighted_auc_interval
from .statistics import auc

QUANTILE, LEAST_SUCCESSES, TRUNCATION_THRESHOLD, LEAST_ROWS, RESAMPLES = 0.90, 3, 0.5, 20, 1000

# The detectors' names and the columns they look at.
#: Detector -> (feature column, score from it); the higher the score, the more failure-like.
DETECTORS = {
    "premature_exit": ("reasoning_n_chunks", lambda c: -c),
    "rambling_overlong": ("reasoning_n_chunks", lambda c: c),
    "thrashing": ("reasoning_direction_changes", lambda c: c),
    "no_commitment": ("reasoning_monotonicity", lambda c: -c),
    "derailment_late": ("reasoning_fall_from_peak", lambda c: c),
    "answer_drift": ("answer_start_minus_reasoning_end", F.abs),
    "answer_meandering": ("answer_direction_changes", lambda c: c),
    "answer_volatility": ("answer_max_rise", lambda c: c),
    "answer_uncommitted": ("answer_monotonicity", lambda c: -c),
    "answer_overrange": ("answer_range_minus_reasoning_range", lambda c: c),
    "truncation_abort": ("truncated", lambda c: c),
}


def scores(features: DataFrame, key: str, target: str, detectors: dict | None = None) -> DataFrame:
    """Long table (key, target, detector, score) of the detectors; a missing feature column is an error."""
    chosen = DETECTORS if detectors is None else detectors
    missing = sorted({column for column, _ in chosen.values()} - set(features.columns))
    if missing:
        raise ValueError(f"no columns {', '.join(missing)} for the detectors")
    found = [F.struct(F.lit(name).alias("detector"), score(F.col(column)).cast("double").alias("score")) for name, (column, score) in chosen.items()]
    return features.select(key, target, F.explode(F.array(*found)).alias("d")).select(key, target, "d.detector", "d.score")


def thresholds(long: DataFrame, target: str) -> DataFrame:
    """Per detector the QUANTILE of the successes' scores, of all scores if there are fewer than LEAST_SUCCESSES."""
    won = F.when(F.col(target) == 1, F.col("score"))
    quantile = F.when(F.count(won) >= LEAST_SUCCESSES, F.percentile(won, QUANTILE)).otherwise(F.percentile("score", QUANTILE))
    return long.groupBy("detector").agg(F.when(F.first("detector") == "truncation_abort", TRUNCATION_THRESHOLD).otherwise(quantile).alias("threshold"))


def flags(long: DataFrame, target: str) -> DataFrame:
    """The long table with threshold and flag: a score strictly above; NULL scores aren't flagged."""
    return long.join(thresholds(long, target), "detector").withColumn("flag", F.coalesce(F.col("score") > F.col("threshold"), F.lit(False)))


def evaluate(flagged: DataFrame, target: str) -> DataFrame:
    """AUC for failure, and precision, recall and lift of the flags; NULL where undefined."""
    failed = (1 - F.col(target)).alias("failed")
    rows = flagged.select("detector", failed, "score", "flag")
    sums = rows.where("score is not null").groupBy("detector").agg(F.count("*").alias("n"), F.avg("failed").alias("base"), F.count_if("flag").alias("flagged"), F.count_if(F.col("flag") & (F.col("failed") == 1)).alias("hits"), F.sum("failed").alias("failures"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    precision = ratio(F.col("hits"), F.col("flagged"))
    return sums.join(auc(rows, "failed", "score", ["detector"]).select("detector", "auc"), "detector", "left").select("detector", "n", "auc", "flagged", precision.alias("precision"), ratio(F.col("hits"), F.col("failures")).alias("recall"), F.when(F.col("base") > 0, precision / F.col("base")).alias("lift"))


def verdict(low: Column, high: Column) -> Column:
    """By the confidence interval of the AUC: above 0.5 the direction is confirmed, below inverted; NULL bounds are too few data."""
    return F.when(low.isNull() | high.isNull(), "insufficient_data").when(low > 0.5, "confirmed").when(high < 0.5, "inverted").otherwise("inconclusive")


def verdicts(flagged: DataFrame, key: str, target: str, resamples: int = RESAMPLES) -> DataFrame:
    """Per detector: n, AUC for failure, its bootstrapped interval and the verdict.

    Precision, recall, F1 and lift of the flags are given only where the verdict is confirmed and something is flagged.
    Fewer than LEAST_ROWS scores, one class only, or a statistic in less than a quarter of the resamples give no interval.
    """
    rows = flagged.select("detector", key, (1 - F.col(target)).alias("failed"), "score", "flag")
    plain = evaluate(flagged, target)
    means = rows.where("score is not null").groupBy("detector").agg(F.avg("failed").alias("base"))
    intervals = weighted_auc_interval(rows, "failed", "score", key, ["detector"], resamples)
    low, high = (F.when((F.col("n") >= LEAST_ROWS) & F.col("auc").isNotNull() & (F.col("resamples") >= resamples // 4), F.col(c)) for c in ("low", "high"))
    out = plain.join(means, "detector").join(intervals, "detector", "left").withColumns({"ci_low": low, "ci_high": high})
    out = out.withColumn("verdict", verdict(F.col("ci_low"), F.col("ci_high")))
    shown = (F.col("verdict") == "confirmed") & (F.col("flagged") > 0)
    both = F.col("precision") + F.col("recall")
    f1 = F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)
    return out.select("detector", "n", "flagged", "base", "auc", "ci_low", "ci_high", "verdict", *(F.when(shown, c).alias(n) for n, c in (("precision", F.col("precision")), ("recall", F.col("recall")), ("f1", f1), ("lift", F.col("lift")))))


def coverage(flagged: DataFrame, key: str, target: str) -> DataFrame:
    """Recall and precision of the union of all flags."""
    per = flagged.groupBy(key).agg(F.max(1 - F.col(target)).alias("failed"), F.bool_or("flag").alias("any"))
    sums = per.agg(F.count("*").alias("n"), F.sum("failed").alias("failures"), F.count_if("any").alias("flagged"), F.count_if(F.col("any") & (F.col("failed") == 1)).alias("hits"))
    return sums.withColumn("union_recall", F.when(F.col("failures") > 0, F.col("hits") / F.col("failures"))).withColumn("union_precision", F.when(F.col("flagged") > 0, F.col("hits") / F.col("flagged")))


def capture_ratio(part: Column, full: Column) -> Column:
    """Share of a full model's lift over chance that a part keeps; NULL without lift."""
    return F.when(full > 0.5, (part - 0.5) / (full - 0.5))
