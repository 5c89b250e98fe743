"""Ranks, correlations, tests, classification metrics and bootstrap, as aggregates and windows.

Standard deviations are those of the population unless a name says otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(value: str | Column, *group: str) -> Column:
    """Rank from 1, ties with their average; NULLs should be dropped before.

    A group is ranked in one task, so groups should be of moderate size.
    """
    value = F.col(value) if isinstance(value, str) else value
    w = Window.partitionBy(*group)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*group, value)) - 1) / F.lit(2.0)


def _grouped(group: list[str]) -> list[str]:
    return group or []


def spearman(df: DataFrame, x: str, y: str, group: list[str] | None = None, least: int = 10) -> DataFrame:
    """n and rho per group; fewer than ``least`` complete pairs give NULL."""
    group = _grouped(group)
    full = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = full.select(*group, average_rank(x, *group).alias("__x"), average_rank(y, *group).alias("__y"))
    out = ranked.groupBy(*group).agg(F.count("*").alias("n"), F.corr("__x", "__y").alias("rho"))
    return out.withColumn("rho", F.when(F.col("n") >= least, F.col("rho")))


def pearson(df: DataFrame, x: str, y: str, group: list[str] | None = None) -> DataFrame:
    full = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return full.groupBy(*_grouped(group)).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"))


#: Ranges of values that running sums over a whole table are dealt into.
RANGES = 64


def value_range(df: DataFrame, value: str, ranges: int = RANGES) -> Column:
    """Number of the range that a value is in, by approximate quantiles of the column; equal values share one.

    The quantiles, at most ``ranges``, are computed once and become literals, so the ranges are the same wherever the
    expression is evaluated.
    """
    probabilities = [k / ranges for k in range(1, ranges)]
    cuts = df.agg(F.percentile_approx(value, F.array(*(F.lit(p) for p in probabilities)), 1000)).first()[0] or []
    return F.size(F.filter(F.array(*(F.lit(c) for c in sorted(set(cuts)))).cast("array<double>"), lambda c: c < F.col(value)))


def running_sums(df: DataFrame, value: str, sums: list[str], group: list[str], descending: bool = False, ties: list[str] | None = None) -> DataFrame:
    """Columns <sum>_before: each sum over all rows before a row in the order of ``value`` (and ties), per group.

    In two steps, so that no task sees all rows of a group: sums of ranges are carried over, and each range adds up its own rows.
    """
    ranged = df.withColumn("__range", value_range(df, value) * (-1 if descending else 1))
    parts = ranged.groupBy(*group, "__range").agg(*(F.sum(c).alias(f"__{c}") for c in sums))
    earlier = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(*group, "__range", *(F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__{c}") for c in sums))
    order = [F.col(value).desc() if descending else F.col(value), *(ties or [])]
    own = Window.partitionBy(*group, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(carried, [*group, "__range"])
    return joined.select("*", *((F.col(f"__{c}") + F.coalesce(F.sum(c).over(own), F.lit(0))).alias(f"{c}_before") for c in sums)).drop("__range", *(f"__{c}" for c in sums))


def quantile(df: DataFrame, value: str, p: float, group: list[str] | None = None) -> DataFrame:
    """The exact quantile per group, interpolated, as column quantile; from counts of values, so no task holds them all."""
    keys = _grouped(group)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__x")).agg(F.count("*").alias("__n"))
    whole = counts.groupBy(*keys).agg(((F.sum("__n") - 1) * p).alias("__at"))
    placed = running_sums(counts, "__x", ["__n"], keys)
    placed = placed.join(whole, keys) if keys else placed.crossJoin(whole)
    first = F.col("__n_before")
    holds = lambda at: F.max(F.when((first <= at) & (at < first + F.col("__n")), F.col("__x")))
    low, high = F.floor("__at"), F.ceil("__at")
    return placed.groupBy(*keys).agg((holds(low) + (holds(high) - holds(low)) * F.max(F.col("__at") - low)).alias("quantile"))


def _by_score(df: DataFrame, target: str, score: str, group: list[str]) -> DataFrame:
    """Positives and negatives of every distinct score."""
    full = df.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    return full.groupBy(*group, F.col(score).alias("__s")).agg(F.count_if(F.col(target) == 1).alias("pos"), F.count_if(F.col(target) == 0).alias("neg"))


def auc(df: DataFrame, target: str, score: str, group: list[str] | None = None) -> DataFrame:
    """Exact ROC AUC per group: positives above negatives, ties half; NULL if a class is missing."""
    group = _grouped(group)
    counts = _by_score(df, target, score, group)
    below = running_sums(counts, "__s", ["neg"], group)
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / F.lit(2.0)))
    sums = below.groupBy(*group).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), won.alias("__won"))
    p, n = F.col("positives").cast("double"), F.col("negatives").cast("double")
    return sums.withColumn("auc", F.when((p > 0) & (n > 0), F.col("__won") / (p * n))).drop("__won")


def average_precision(df: DataFrame, target: str, score: str, group: list[str] | None = None) -> DataFrame:
    """Sum of precision times the step in recall over distinct scores, highest first."""
    group = _grouped(group)
    above = running_sums(_by_score(df, target, score, group), "__s", ["pos", "neg"], group, descending=True)
    hits = F.col("pos_before") + F.col("pos")
    precision = hits / (hits + F.col("neg_before") + F.col("neg"))
    return above.groupBy(*group).agg(F.when(F.sum("pos") > 0, F.sum(precision * F.col("pos")) / F.sum("pos")).alias("average_precision"))


def binary_metrics(df: DataFrame, target: str, probability: str, threshold: float = 0.5, group: list[str] | None = None) -> DataFrame:
    """Confusion counts, accuracy, balanced accuracy, precision, recall, F1 and Brier score."""
    hit, true = F.col(probability) >= threshold, F.col(target) == 1
    sums = df.groupBy(*_grouped(group)).agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"), F.count_if(~hit & ~true).alias("tn"), F.avg((F.col(probability) - F.col(target)) * (F.col(probability) - F.col(target))).alias("brier"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (
        sums.withColumn("accuracy", ratio(tp + tn, tp + fp + fn + tn))
        .withColumn("balanced_accuracy", (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2)
        .withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))
    )


def class_metrics(df: DataFrame, truth: str, predicted: str, group: list[str] | None = None) -> DataFrame:
    """Support, precision, recall and F1 of every class that occurs as truth or prediction."""
    group = _grouped(group)
    pairs = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(*group, F.col(truth).alias("__t"), F.col(predicted).alias("__p")).agg(F.count("*").alias("__n"))
    long = pairs.select(*group, F.explode(F.array(F.struct(F.col("__t").alias("class"), F.col("__n").alias("support"), F.lit(0).cast("bigint").alias("guessed"), F.when(F.col("__t") == F.col("__p"), F.col("__n")).otherwise(0).alias("right")), F.struct(F.col("__p").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("__n").alias("guessed"), F.lit(0).cast("bigint").alias("right")))).alias("r")).select(*group, "r.*")
    sums = long.groupBy(*group, "class").agg(F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("right").alias("right"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return sums.select(*group, "class", "support", ratio("right", "guessed").alias("precision"), ratio("right", "support").alias("recall"), F.when(F.col("guessed") + F.col("support") > 0, 2 * F.col("right") / (F.col("guessed") + F.col("support"))).otherwise(0.0).alias("f1"))


def averaged_metrics(per_class: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Macro precision, recall and F1, and the F1 weighted by support."""
    return per_class.groupBy(*_grouped(group)).agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def kappa(df: DataFrame, a: str, b: str, group: list[str] | None = None) -> DataFrame:
    """n, agreement and Cohen's kappa (NULL where chance agreement is complete)."""
    group = _grouped(group)
    full = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = full.groupBy(*group, F.col(a).alias("__a"), F.col(b).alias("__b")).agg(F.count("*").alias("__n"))
    whole = Window.partitionBy(*group)
    rows, columns, n = F.sum("__n").over(Window.partitionBy(*group, "__a")), F.sum("__n").over(Window.partitionBy(*group, "__b")), F.sum("__n").over(whole)
    # Chance agreement: of each class its row share times its column share, taken from one cell per row and column.
    marked = cells.select(*group, "__a", "__b", "__n", rows.alias("__r"), columns.alias("__c"), n.alias("__all"))
    right = marked.groupBy(*group, "__all").agg(F.sum(F.when(F.col("__a") == F.col("__b"), F.col("__n")).otherwise(0)).alias("__right"))
    margin_a = marked.select(*group, F.col("__a").alias("__k"), "__r").distinct()
    margin_b = marked.select(*group, F.col("__b").alias("__k"), "__c").distinct()
    chance = margin_a.join(margin_b, [*group, "__k"]).groupBy(*group).agg(F.sum(F.col("__r").cast("double") * F.col("__c")).alias("__chance"))
    joined = right.join(chance, group, "left") if group else right.crossJoin(chance)
    po, pe = F.col("__right") / F.col("__all"), F.coalesce("__chance", F.lit(0.0)) / (F.col("__all").cast("double") * F.col("__all"))
    return joined.select(*group, F.col("__all").alias("n"), po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(F.when(po == 1, 1.0)).alias("kappa"))


def wilcoxon(df: DataFrame, delta: str, group: list[str] | None = None) -> DataFrame:
    """Signed-rank sums without zeros, the smaller one, rank-biserial effect and the normal approximation z."""
    group = _grouped(group)
    ranked = df.where((F.col(delta).isNotNull()) & (F.col(delta) != 0)).select(*group, F.col(delta).alias("__d"), average_rank(F.abs(F.col(delta)), *group).alias("__r"))
    sums = ranked.groupBy(*group).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("__d") > 0, F.col("__r"))), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(F.col("__d") < 0, F.col("__r"))), F.lit(0.0)).alias("w_minus"))
    n, both = F.col("n").cast("double"), F.col("w_plus") + F.col("w_minus")
    z = (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return sums.withColumn("w", F.least("w_plus", "w_minus")).withColumn("rank_biserial", (F.col("w_plus") - F.col("w_minus")) / both).withColumn("z", z)


def paired_shift(df: DataFrame, before: str, after: str, group: list[str] | None = None) -> DataFrame:
    """Mean and deviation of the differences, paired Cohen's d (population) and t (sample)."""
    d = F.col(after) - F.col(before)
    sums = df.where(d.isNotNull()).groupBy(*_grouped(group)).agg(F.count("*").alias("n"), F.avg(d).alias("mean_delta"), F.stddev_pop(d).alias("std_delta"), F.stddev_samp(d).alias("__s"))
    return sums.withColumn("cohens_d", F.when(F.col("std_delta") > 0, F.col("mean_delta") / F.col("std_delta")).otherwise(0.0)).withColumn("t", F.when(F.col("__s") > 0, F.col("mean_delta") / (F.col("__s") / F.sqrt("n")))).drop("__s")


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: groups, rows, between and within sums of squares, and F."""
    per = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    sums = per.agg(F.count("*").alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum(F.col("n") * F.col("m")) * F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("ss_between"), F.sum(F.col("n") * F.col("v")).alias("ss_within"))
    return sums.withColumn("f", F.when((F.col("k") > 1) & (F.col("ss_within") > 0), (F.col("ss_between") / (F.col("k") - 1)) / (F.col("ss_within") / (F.col("n") - F.col("k")))))


def chi_square(cells: DataFrame, row: str, column: str, count: str) -> DataFrame:
    """Statistic and degrees of freedom of a contingency table in long form; empty rows and columns don't count."""
    filled = cells.groupBy(row, column).agg(F.sum(count).alias("o"))
    marked = filled.select(row, column, "o", F.sum("o").over(Window.partitionBy(row)).alias("r"), F.sum("o").over(Window.partitionBy(column)).alias("c")).where("r > 0 and c > 0")
    whole = marked.agg(F.sum("o").alias("n"))
    parts = marked.crossJoin(F.broadcast(whole)).withColumn("e", F.col("r") * F.col("c") / F.col("n"))
    return parts.agg(F.sum((F.col("o") - F.col("e")) * (F.col("o") - F.col("e")) / F.col("e")).alias("chi2"), ((F.count_distinct(row) - 1) * (F.count_distinct(column) - 1)).alias("dof"))


def resample_index(resample: Column, draw: Column, n: Column, seed: int = 42) -> Column:
    """A row number from 0 to n - 1 for each draw of each resample, by integer arithmetic that any engine can repeat."""
    mixed = (resample * 1_103_515_245 + draw * 12_345 + seed) % 2_147_483_647
    again = (mixed * 48_271) % 2_147_483_647
    return ((again * 16_807) % 2_147_483_647) % n


def numbered(df: DataFrame, order: str) -> DataFrame:
    """The rows with their places __i from 0 in an order of distinct values, without a task that sees them all."""
    return running_sums(df.withColumn("__one", F.lit(1)), order, ["__one"], []).withColumn("__i", F.col("__one_before").cast("bigint")).drop("__one", "__one_before")


def drawn(df: DataFrame, order: str, resamples: int, seed: int = 42) -> DataFrame:
    """resample, __times and the row: how often each row is drawn when as many are drawn with replacement as there are.

    Draws are counted per row, and the join is on the row's place in an order of distinct values.
    """
    rows = numbered(df, order)
    n = df.count()
    draws = df.sparkSession.range(resamples * n).select(F.floor(F.col("id") / F.lit(n)).cast("bigint").alias("resample"), F.pmod("id", F.lit(n)).alias("draw"))
    places = draws.select("resample", resample_index(F.col("resample"), F.col("draw"), F.lit(n), seed).cast("bigint").alias("__i"))
    return places.groupBy("resample", "__i").agg(F.count("*").alias("__times")).join(rows, "__i").drop("__i")


def bootstrap_means(df: DataFrame, value: str, order: str, resamples: int, seed: int = 42) -> DataFrame:
    """resample and the mean of n values drawn with replacement; give the difference of two columns for a paired bootstrap."""
    rows = drawn(df.where(F.col(value).isNotNull()).select(order, F.col(value).alias("__v")), order, resamples, seed)
    return rows.groupBy("resample").agg((F.sum(F.col("__v") * F.col("__times")) / F.sum("__times")).alias("mean"))


def repeated(rows: DataFrame) -> DataFrame:
    """The drawn rows one by one, for statistics that take no weights."""
    return rows.withColumn("__times", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).drop("__times")


def interval(df: DataFrame, value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Resamples, mean and percentile interval of a bootstrapped statistic; the rows are the resamples, so they are few."""
    return df.agg(F.count(value).alias("resamples"), F.avg(value).alias("mean"), F.percentile(value, low).alias("low"), F.percentile(value, high).alias("high"))


def auc_difference(df: DataFrame, target: str, a: str, b: str, order: str, resamples: int, delta: float = 0.03) -> DataFrame:
    """Paired bootstrap of the difference of two scores' AUC, and a verdict: win or regress beyond ``delta`` if the interval leaves out 0."""
    rows = repeated(drawn(df.select(order, target, a, b), order, resamples))
    of = lambda score, name: auc(rows, target, score, ["resample"]).select("resample", F.col("auc").alias(name))
    both = of(a, "__a").join(of(b, "__b"), "resample").withColumn("difference", F.col("__a") - F.col("__b"))
    m, lo, hi = F.col("mean"), F.col("low"), F.col("high")
    return interval(both, "difference").withColumn("verdict", F.when((m >= delta) & (lo > 0), "win").when((m <= -delta) & (hi < 0), "regress").otherwise("inconclusive"))


def importance_summary(df: DataFrame, feature: str, importance: str) -> DataFrame:
    """Mean and sample standard deviation of a feature's importance over the folds."""
    return df.groupBy(feature).agg(F.count(importance).alias("folds"), F.avg(importance).alias("mean"), F.stddev_samp(importance).alias("std"))


def normal_p(z: float, tails: int = 2) -> float:
    """p value of a standard normal statistic."""
    return tails * 0.5 * math.erfc(abs(z) / math.sqrt(2))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        numerator = 1.0 if i == 0 else (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        d = 1 / max(1e-300, 1 + numerator * d) if 1 + numerator * d > 0 else 1 / min(-1e-300, 1 + numerator * d)
        c = 1 + numerator / c
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (f - 1)


def t_p(t: float, dof: float) -> float:
    """Two-sided p value of Student's t."""
    return incomplete_beta(dof / 2, 0.5, dof / (dof + t * t))


def chi_square_p(x: float, dof: int) -> float:
    """Upper tail of the chi-square distribution: 1 - P(dof / 2, x / 2), by the series of the incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, y = dof / 2, x / 2
    term = total_ = 1 / a
    for n in range(1, 10_000):
        term *= y / (a + n)
        total_ += term
        if term < total_ * 1e-15:
            break
    return max(0.0, 1 - total_ * math.exp(-y + a * math.log(y) - math.lgamma(a)))


def correlation_p(rho: float | None, n: int, tests: int = 1) -> float | None:
    """Two-sided p of a correlation by the t approximation, times the number of tests (at most 1)."""
    if rho is None or n < 3:
        return None
    if abs(rho) >= 1:
        return 0.0
    return min(1.0, tests * t_p(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2))
