"""Several attempts at a problem: selection, votes, coverage and risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .statistics import running_sums


def best_attempt(df: DataFrame, problem: str, score: str, answered: str, run_order: str) -> DataFrame:
    """One attempt per problem: with a score first, then the higher score, then answered ones, then the earlier run."""
    order = Window.partitionBy(problem).orderBy(F.col(score).desc_nulls_last(), F.col(answered).desc(), run_order)
    return df.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def plurality_vote(df: DataFrame, problem: str, answer: str, run_order: str, correct: str) -> DataFrame:
    """Most frequent answer per problem, the earliest one on ties.

    consistency divides by all attempts, also those without an answer; the vote is correct if at least half of its members are.
    """
    runs = df.groupBy(problem).agg(F.count("*").alias("attempts"))
    votes = df.where(F.col(answer).isNotNull()).groupBy(problem, answer).agg(F.count("*").alias("votes"), F.min(run_order).alias("__first"), F.avg(F.col(correct).cast("double")).alias("__right"))
    order = Window.partitionBy(problem).orderBy(F.col("votes").desc(), "__first")
    top = votes.withColumn("__n", F.row_number().over(order)).where("__n = 1")
    return runs.join(top, problem, "left").select(problem, answer, F.coalesce("votes", F.lit(0)).alias("votes"), (F.coalesce("votes", F.lit(0)) / F.col("attempts")).alias("consistency"), F.coalesce(F.col("__right") >= 0.5, F.lit(False)).alias("vote_correct"))


def pass_at_k(df: DataFrame, problem: str, correct: str, *by: str) -> DataFrame:
    """Mean share of correct attempts and share of problems with a correct one."""
    per = df.groupBy(problem, *by).agg(F.avg(F.col(correct).cast("double")).alias("__mean"), F.max(F.col(correct).cast("int")).alias("__any"))
    return per.groupBy(*by).agg(F.count("*").alias("problems"), F.avg("__mean").alias("pass_at_1"), F.avg("__any").alias("pass_at_k"))


def selection_summary(df: DataFrame, chosen: DataFrame, problem: str, correct: str) -> DataFrame:
    """Average, oracle and selected accuracy."""
    base = pass_at_k(df, problem, correct)
    return base.crossJoin(chosen.agg(F.avg(F.col(correct).cast("double")).alias("selected")))


def prefix_totals(df: DataFrame, score: str, target: str, tie: str) -> DataFrame:
    """place (from 1 by descending score), hits (successes so far) and n, by running sums over ranges of the score."""
    rows = df.select(score, tie, F.col(target).cast("bigint").alias(target)).withColumn("row", F.lit(1).cast("bigint"))
    whole = rows.agg(F.count("*").alias("n"))
    placed = running_sums(rows, score, ["row", target], [], descending=True, ties=[tie]).crossJoin(F.broadcast(whole))
    return placed.select(tie, score, target, (F.col("row_before") + 1).alias("place"), (F.col(f"{target}_before") + F.col(target)).alias("hits"), "n")


def coverage_risk(df: DataFrame, score: str, target: str, tie: str, points: int = 20) -> DataFrame:
    """Accuracy and risk of the best-scored rows at ``points`` evenly spaced coverages (at least one row each)."""
    totals = prefix_totals(df.where(F.col(score).isNotNull()), score, target, tie)
    sizes = F.transform(F.sequence(F.lit(1), F.lit(points)), lambda i: F.struct((i / points).alias("coverage"), F.greatest(F.round(F.col("n") * i / points).cast("long"), F.lit(1)).alias("size")))
    at = totals.select("place", "hits", F.explode(F.filter(sizes, lambda s: s["size"] == F.col("place"))).alias("p"))
    return at.select("p.coverage", F.col("place").alias("kept"), (F.col("hits") / F.col("place")).alias("accuracy"), (1 - F.col("hits") / F.col("place")).alias("risk"))


def precision_at_fraction(df: DataFrame, score: str, target: str, tie: str, fractions: tuple[float, ...] = (0.1, 0.25, 0.5)) -> DataFrame:
    """Precision among the best max(1, int(n * fraction)) rows."""
    totals = prefix_totals(df.where(F.col(score).isNotNull()), score, target, tie)
    sizes = F.array(*(F.struct(F.lit(f).alias("fraction"), F.greatest(F.floor(F.col("n") * f).cast("long"), F.lit(1)).alias("size")) for f in fractions))
    return totals.select("place", "hits", F.explode(F.filter(sizes, lambda s: s["size"] == F.col("place"))).alias("p")).select("p.fraction", F.col("place").alias("kept"), (F.col("hits") / F.col("place")).alias("precision"))


def threshold_coverage(df: DataFrame, score: str, target: str, thresholds: list[float]) -> DataFrame:
    """Coverage and accuracy of the rows whose score reaches each threshold."""
    whole = df.agg(F.count("*").alias("__all"))
    hit = df.select(F.explode(F.array(*(F.lit(t) for t in thresholds))).alias("threshold"), score, target).groupBy("threshold").agg(F.count_if(F.col(score) >= F.col("threshold")).alias("kept"), F.avg(F.when(F.col(score) >= F.col("threshold"), F.col(target).cast("double"))).alias("accuracy"))
    return hit.crossJoin(F.broadcast(whole)).select("threshold", "kept", (F.col("kept") / F.col("__all")).alias("coverage"), "accuracy")


def helped_or_hurt(df: DataFrame, key: str, condition: str, value: str, candidate: str, baselines: list[str], tolerance: float = 0.01) -> DataFrame:
    """Per key the candidate's value against the best of several baselines: helped, hurt or neutral."""
    own = df.where(F.col(condition) == candidate).select(key, F.col(value).alias("own"))
    best = df.where(F.col(condition).isin(baselines)).groupBy(key).agg(F.max(value).alias("best"), F.max_by(condition, F.struct(F.col(value), F.col(condition))).alias("best_baseline"))
    change = F.col("own") - F.col("best")
    return own.join(best, key).select(key, "own", "best", "best_baseline", F.when(change > tolerance, "helped").when(change < -tolerance, "hurt").otherwise("neutral").alias("verdict"))
