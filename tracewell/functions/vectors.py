"""Vector and fixed-length sequence functions as Column -> Column on arrays of doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)


def mean(xs: Column) -> Column:
    return F.when(F.size(xs) > 0, total(xs) / F.size(xs))


def dot(a: Column, b: Column) -> Column:
    """Scalar product; elements are widened to doubles before they are summed."""
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine between -1 and 1; 0 if a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 0 if a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size)))


def differences(xs: Column) -> Column:
    """x[i + 1] - x[i]; empty for fewer than two elements."""
    n = F.size(xs)
    return F.zip_with(F.slice(xs, 2, F.greatest(n - 1, F.lit(0))), F.slice(xs, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b - a)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body, or a function inside it, refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def centred(xs: Column) -> Column:
    return bound(xs, lambda v: bound(mean(v), lambda m: F.transform(v, lambda x: x - m)))


def interpolate(xs: Column, points: int = 20) -> Column:
    """Linear interpolation onto ``points`` evenly spaced places; one value repeats, none gives an empty array."""

    def interpolated(xs: Column) -> Column:
        n = F.size(xs)

        def at(j: Column) -> Column:
            place = j * (n - 1) / (points - 1)
            low = F.least(F.floor(place).cast("int"), n - 1)
            high = F.least(low + 1, n - 1)
            return F.get(xs, low) + (F.get(xs, high) - F.get(xs, low)) * (place - low)

        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)).otherwise(F.array().cast("array<double>"))

    return bound(xs, interpolated)


def segment_means(xs: Column, size: int) -> tuple[Column, Column, Column]:
    """Means of the first, middle and last third of ``size`` elements; earlier thirds take the remainder."""
    lengths = [size // 3 + (k < size % 3) for k in range(3)]
    starts = [1, 1 + lengths[0], 1 + lengths[0] + lengths[1]]
    return tuple(mean(F.slice(xs, s, n)) for s, n in zip(starts, lengths, strict=True))


def _signs(xs: Column, tolerance: float) -> Column:
    return F.transform(xs, lambda x: F.when(x > tolerance, 1).when(x < -tolerance, -1).otherwise(0))


def direction_changes(xs: Column, tolerance: float = 1e-8) -> Column:
    """Sign flips between successive elements that aren't zero."""
    signs = F.filter(_signs(xs, tolerance), lambda s: s != 0)
    return F.size(F.filter(differences(signs), lambda d: d != 0))


def zero_crossings(xs: Column, tolerance: float = 1e-8) -> Column:
    """Changes of side: zeros are skipped, and a zero at the start is no side."""
    signs = _signs(xs, tolerance)
    start = F.struct(F.get(signs, F.lit(0)).alias("side"), F.lit(0).alias("n"))

    def step(state: Column, s: Column) -> Column:
        crossed = (s != 0) & (state["side"] != 0) & (s != state["side"])
        return F.struct(F.when(s != 0, s).otherwise(state["side"]).alias("side"), (state["n"] + F.when(crossed, 1).otherwise(0)).alias("n"))

    return F.coalesce(F.aggregate(F.slice(signs, 2, F.greatest(F.size(xs), F.lit(1))), start, step, lambda s: s["n"]), F.lit(0))


def argmax(xs: Column) -> Column:
    """0-based place of the first maximum."""
    return F.array_position(xs, F.array_max(xs)).cast("int") - 1


def argmin(xs: Column) -> Column:
    return F.array_position(xs, F.array_min(xs)).cast("int") - 1


def trajectory_features(xs: Column, prefix: str, points: int = 20) -> dict[str, Column]:
    """Shape features of an array of values, centred and interpolated to ``points``; NULL for an empty array.

    Pass a materialized column: every feature refers to it.
    """
    d = differences(xs)
    second = differences(d)
    start, end = F.get(xs, F.lit(0)), F.get(xs, F.lit(points - 1))
    top, bottom = F.array_max(xs), F.array_min(xs)
    early, middle, late = segment_means(xs, points)
    variation = total(F.transform(d, lambda x: F.abs(x)))
    share = lambda test: F.size(F.filter(xs, test)) / F.lit(points)
    m = mean(xs)
    features = {
        "start": start,
        "end": end,
        "end_minus_start": end - start,
        "std": F.sqrt(mean(F.transform(xs, lambda x: (x - m) * (x - m)))),
        "range": top - bottom,
        "min": bottom,
        "max": top,
        "early_mean": early,
        "mid_mean": middle,
        "late_mean": late,
        "late_minus_early": late - early,
        "total_variation": variation,
        "monotonicity": F.abs(end - start) / F.greatest(variation, F.lit(1e-8)),
        "direction_changes": direction_changes(d),
        "zero_crossings": zero_crossings(xs),
        "peak_pos": argmax(xs) / F.lit(points - 1),
        "trough_pos": argmin(xs) / F.lit(points - 1),
        "rebound_from_trough": end - bottom,
        "fall_from_peak": top - end,
        "max_rise": F.array_max(d),
        "max_drop": F.greatest(F.lit(0.0), -F.array_min(d)),
        "max_rise_pos": argmax(d) / F.lit(points - 2),
        "max_drop_pos": argmin(d) / F.lit(points - 2),
        "curvature_abs_mean": mean(F.transform(second, lambda x: F.abs(x))),
        "positive_mass": mean(F.transform(xs, lambda x: F.greatest(x, F.lit(0.0)))),
        "negative_mass": mean(F.transform(xs, lambda x: F.greatest(-x, F.lit(0.0)))),
        "time_positive": share(lambda x: x > 0),
        "time_negative": share(lambda x: x < 0),
    }
    some = F.size(xs) > 0
    return {f"{prefix}_{name}": F.when(some, c) for name, c in features.items()}


def series_columns(xs: Column, prefix: str, points: int = 20) -> dict[str, Column]:
    """Fixed-width columns of an interpolated array."""
    return {f"{prefix}_traj_t{i:02d}": F.get(xs, F.lit(i)) for i in range(points)}


def cross_features(reasoning: Column, answer: Column) -> dict[str, Column]:
    """Differences of an answer's and a reasoning's values; NULL if one is empty."""
    some = (F.size(reasoning) > 0) & (F.size(answer) > 0)
    spread = lambda xs: F.array_max(xs) - F.array_min(xs)
    last = F.element_at(reasoning, -1)
    features = {
        "answer_minus_reasoning_mean": mean(answer) - mean(reasoning),
        "answer_start_minus_reasoning_end": F.get(answer, F.lit(0)) - last,
        "answer_end_minus_reasoning_end": F.element_at(answer, -1) - last,
        "answer_range_minus_reasoning_range": spread(answer) - spread(reasoning),
    }
    return {name: F.when(some, c) for name, c in features.items()}


def comparison_density(pairs: Column, n: Column) -> Column:
    """Share of the n (n - 1) / 2 unordered pairs that an array of two-element arrays holds; NULL below two items."""
    seen = F.size(F.array_distinct(F.transform(F.filter(pairs, lambda p: F.size(p) == 2), lambda p: F.array_sort(p))))
    return F.when(n >= 2, seen / (n * (n - 1) / 2))


def signed_confidence(correct: Column, confidence: Column) -> Column:
    """Confidence, negative where the verdict is incorrect."""
    return F.when(correct, confidence).otherwise(-confidence)
