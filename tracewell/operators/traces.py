"""Ordered traces of levels: deltas, jumps, transition matrices and their features.

A trace is the rows of equal keys in a given order; levels are small integers
(0 macro, 1 meso, 2 micro).  Everything is a window or an aggregate on the
trace key, so one shuffle by key serves a whole chain of these operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 3


def _ordered(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def with_delta(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "delta") -> DataFrame:
    """Difference to the row before; NULL in a trace's first row."""
    return df.withColumn(out, F.col(value) - F.lag(value).over(_ordered(keys, order)))


def sign(x: Column, tolerance: float = 0.0) -> Column:
    return F.when(x > tolerance, 1).when(x < -tolerance, -1).otherwise(0)


def jump_metrics(df: DataFrame, keys: list[str], order: list[str], level: str) -> DataFrame:
    """n_steps, jump_count, mean_abs_delta, max_jump, level_variance, direction_changes, jump_rate per trace.

    Traces of one step have zeros; direction changes are sign flips between successive non-zero deltas.
    """
    w = _ordered(keys, order)
    steps = with_delta(df, keys, order, level)
    # The sign of the last non-zero delta before this row.
    before = F.last(F.when(F.col("delta") != 0, sign(F.col("delta"))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flips = steps.withColumn("flip", (F.col("delta") != 0) & (sign(F.col("delta")) != before))
    metrics = flips.groupBy(*keys).agg(
        F.count("*").alias("n_steps"),
        F.count_if(F.col("delta") != 0).alias("jump_count"),
        F.round(F.coalesce(F.avg(F.abs("delta")), F.lit(0.0)), 6).alias("mean_abs_delta"),
        F.coalesce(F.max(F.abs("delta")), F.lit(0)).alias("max_jump"),
        F.round(F.var_pop(level), 6).alias("level_variance"),
        F.count_if("flip").alias("direction_changes"),
    )
    rate = F.when(F.col("n_steps") > 1, F.col("jump_count") / (F.col("n_steps") - 1)).otherwise(0.0)
    return metrics.withColumn("jump_rate", F.round(rate, 6))


def hard_transitions(df: DataFrame, keys: list[str], order: list[str], level: str) -> DataFrame:
    """Cells t_ij of the transition matrix divided by its total, and n_transitions; all 0 for one step."""
    pairs = df.withColumn("__next", F.lead(level).over(_ordered(keys, order)))
    cells = [(i, j) for i in range(LEVELS) for j in range(LEVELS)]
    hits = pairs.groupBy(*keys).agg(F.count("__next").alias("n_transitions"), *(F.count_if((F.col(level) == i) & (F.col("__next") == j)).alias(f"t_{i}{j}") for i, j in cells))
    share = lambda c: F.when(F.col("n_transitions") > 0, F.col(c) / F.col("n_transitions")).otherwise(0.0)
    return hits.select(*keys, "n_transitions", *(share(f"t_{i}{j}").alias(f"t_{i}{j}") for i, j in cells))


def soft_transitions(df: DataFrame, keys: list[str], order: list[str], probabilities: list[str]) -> DataFrame:
    """Mean outer product of successive probability vectors, cells s_ij."""
    w = _ordered(keys, order)
    ahead = df.select("*", *(F.lead(p).over(w).alias(f"__next_{p}") for p in probabilities))
    return ahead.groupBy(*keys).agg(*(F.coalesce(F.avg(F.col(p) * F.col(f"__next_{q}")), F.lit(0.0)).alias(f"s_{i}{j}") for i, p in enumerate(probabilities) for j, q in enumerate(probabilities)))


def transition_features(matrix: DataFrame, prefix: str = "t_") -> DataFrame:
    """Entropy (log2, zeros skipped), self-loop share, off-diagonal deviation, macro-micro shuttle, upward and downward share, largest cell."""
    cell = {(i, j): F.col(f"{prefix}{i}{j}") for i in range(LEVELS) for j in range(LEVELS)}
    total = sum(cell.values(), F.lit(0.0))
    off = [c for (i, j), c in cell.items() if i != j]
    off_sum = sum(off, F.lit(0.0))
    mean = off_sum / len(off)
    share = lambda part, whole: F.when(whole == 0, 0.0).otherwise(part / whole)
    entropy = -sum((F.when(c > 0, c * F.log2(c)).otherwise(0.0) for c in cell.values()), F.lit(0.0))
    largest = F.greatest(*cell.values())
    return (
        matrix.withColumn("self_loop_ratio", share(cell[0, 0] + cell[1, 1] + cell[2, 2], total))
        .withColumn("entropy", F.abs(entropy))
        .withColumn("oscillation_index", F.sqrt(sum(((c - mean) * (c - mean) for c in off), F.lit(0.0)) / len(off)))
        .withColumn("shuttle", share(cell[0, 2] + cell[2, 0], total))
        .withColumn("upward_ratio", share(cell[0, 1] + cell[0, 2] + cell[1, 2], off_sum))
        .withColumn("downward_ratio", share(cell[1, 0] + cell[2, 0] + cell[2, 1], off_sum))
        .withColumn("dominant_cell", (F.array_position(F.array(*cell.values()), largest) - 1).cast("int"))
    )


def cell_table(matrix: DataFrame, group: str, prefix: str = "t_") -> DataFrame:
    """Contingency table of a group column and the nine cells: summed transitions (cell value times n_transitions)."""
    names = [f"{prefix}{i}{j}" for i in range(LEVELS) for j in range(LEVELS)]
    summed = matrix.groupBy(group).agg(*(F.sum(F.round(F.col(c) * F.col("n_transitions"))).alias(c) for c in names))
    return summed.unpivot([group], names, "cell", "n")


def step_features(df: DataFrame, keys: list[str], order: list[str], value: str, tolerance: float = 1e-8) -> DataFrame:
    """Per step: place, remaining steps, centred value, distances from start, end, running peak and trough, deltas and curvature."""
    w = _ordered(keys, order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = F.col(value)
    out = df.select(
        "*",
        (F.row_number().over(w) - 1).alias("step_index"),
        F.count("*").over(Window.partitionBy(*keys)).alias("n_steps"),
        (x - F.avg(x).over(whole)).alias("centred"),
        (x - F.first(x).over(whole)).alias("from_start"),
        (F.last(x).over(whole) - x).alias("to_end"),
        (x - F.coalesce(F.lag(x).over(w), x)).alias("delta_prev"),
        (F.coalesce(F.lead(x).over(w), x) - x).alias("delta_next"),
        (F.max(x).over(so_far) - x).alias("fall_from_peak"),
        (x - F.min(x).over(so_far)).alias("rebound_from_trough"),
    )
    return (
        out.withColumn("step_pos", F.col("step_index") / F.greatest(F.col("n_steps") - 1, F.lit(1)))
        .withColumn("remaining_steps", F.col("n_steps") - F.col("step_index") - 1)
        .withColumn("curvature", F.col("delta_next") - F.col("delta_prev"))
        .withColumn("is_peak_so_far", (F.col("fall_from_peak") <= tolerance).cast("int"))
        .withColumn("is_trough_so_far", (F.col("rebound_from_trough") <= tolerance).cast("int"))
    )


def level_profile(df: DataFrame, keys: list[str], level: str, prefix: str = "") -> DataFrame:
    """n, mean level and the share of each level per key."""
    return df.groupBy(*keys).agg(F.count("*").alias(f"{prefix}n"), F.avg(level).alias(f"{prefix}mean"), *((F.count_if(F.col(level) == k) / F.count("*")).alias(f"{prefix}p{k}") for k in range(LEVELS)))


EPSILON = 1e-10


def alignment_features(df: DataFrame, context: str = "c_", reasoning: str = "r_", ratio_cap: float = 100.0) -> DataFrame:
    """Divergence, diversities, mode match and gaps of two level distributions (columns prefix + p0 to p2).

    Distributions are smoothed by EPSILON and rescaled; the divergence is the Jensen-Shannon divergence in nats,
    diversities are entropies in bits, soft_mean_gap is the mean absolute difference.
    """
    raw = {side: [F.col(f"{side}p{k}") for k in range(LEVELS)] for side in (context, reasoning)}
    smooth = {side: [(p + EPSILON) / (ps[0] + ps[1] + ps[2] + LEVELS * EPSILON) for p in ps] for side, ps in raw.items()}
    c, r = smooth[context], smooth[reasoning]
    middle = [(a + b) / 2 for a, b in zip(c, r, strict=True)]
    jsd = sum((a * F.log(a / m) + b * F.log(b / m) for a, b, m in zip(c, r, middle, strict=True)), F.lit(0.0)) / 2
    entropy = lambda ps: -sum((p * F.log2(p) for p in ps), F.lit(0.0))
    mode = lambda ps: F.array_position(F.array(*ps), F.greatest(*ps))
    out = df.withColumn("jsd", jsd).withColumn("context_diversity", entropy(c)).withColumn("reasoning_diversity", entropy(r))
    ratio = F.when(F.col("context_diversity") > EPSILON, F.least(F.col("reasoning_diversity") / F.col("context_diversity"), F.lit(ratio_cap))).otherwise(F.when(F.col("reasoning_diversity") > EPSILON, ratio_cap).otherwise(1.0))
    mean = lambda ps: (ps[0] + ps[1] + ps[2]) / LEVELS
    centred = {side: [p - mean(ps) for p in ps] for side, ps in raw.items()}
    dot = lambda a, b: sum((x * y for x, y in zip(a, b, strict=True)), F.lit(0.0))
    spread = {side: F.sqrt(dot(ps, ps) / LEVELS) for side, ps in centred.items()}
    flat = (spread[context] < EPSILON) | (spread[reasoning] < EPSILON)
    return (
        out.withColumn("diversity_ratio", ratio)
        .withColumn("dominant_level_match", (mode(raw[context]) == mode(raw[reasoning])).cast("int"))
        .withColumn("distribution_correlation", F.when(~flat, dot(centred[context], centred[reasoning]) / LEVELS / (spread[context] * spread[reasoning])))
        .withColumn("soft_mean_gap", sum((F.abs(a - b) for a, b in zip(c, r, strict=True)), F.lit(0.0)) / LEVELS)
    )


def gap_features(steps: DataFrame, keys: list[str], level: str, context_mean: str, confidence: str | None = None) -> DataFrame:
    """Mean, largest and confidence-weighted distance of step levels from the context's mean level."""
    gap = F.abs(F.col(level) - F.col(context_mean))
    mean = F.avg(gap)
    weight = F.sum(confidence) if confidence else None
    weighted = F.when(weight > 0, F.sum(F.col(confidence) * gap) / weight).otherwise(mean) if confidence else mean
    return steps.groupBy(*keys).agg(mean.alias("mean_alignment_gap"), F.max(gap).alias("max_alignment_gap"), weighted.alias("weighted_alignment_gap"))
