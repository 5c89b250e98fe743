"""Samples, splits and folds by hash order: repeatable, and exact in their counts.

Row numbers are taken inside a class, group or slice.  Where a whole table is put in
order, the hash first deals it into parts whose sizes are summed, so no task sees all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .statistics import running_sums


def hash_order(*columns: str, seed: int = 42) -> Column:
    return F.xxhash64(*columns, F.lit(seed))


def per_class(df: DataFrame, label: str | list[str], n: int | Column, order: list[Column | str]) -> DataFrame:
    """The first n rows of every class in an order."""
    keys = [label] if isinstance(label, str) else label
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def quota_sample(df: DataFrame, stratum: str, quotas: dict[str, int], id_col: str, seed: int = 42, order: Column | None = None) -> DataFrame:
    """Of every stratum its quota of rows, in hash order or a given one; other strata give none."""
    quota = F.create_map(*(x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))))[F.col(stratum)]
    return per_class(df.where(F.col(stratum).isin(list(quotas))), stratum, quota, [hash_order(id_col, seed=seed) if order is None else order, id_col])


def priority_quota_sample(df: DataFrame, pools: list[tuple[str, Column, int]], id_col: str, seed: int = 42, order: Column | None = None) -> DataFrame:
    """Quota samples from overlapping pools: a row belongs to the first pool whose test it passes, so none is used twice."""
    pool = F.coalesce(*(F.when(test, F.lit(name)) for name, test, _ in pools))
    return quota_sample(df.withColumn("pool", pool), "pool", {name: n for name, _, n in pools}, id_col, seed, order)


def allocate(counts: dict[str, int], n: int) -> dict[str, int]:
    """Proportional sizes by rounding, in the strata's order; the last takes what remains."""
    whole, left, out = sum(counts.values()), n, {}
    names = sorted(counts)
    for name in names[:-1]:
        out[name] = min(counts[name], round(n * counts[name] / whole), left)
        left -= out[name]
    if names:
        out[names[-1]] = min(counts[names[-1]], left)
    return out


def proportional_sample(df: DataFrame, stratum: str, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """n rows with every stratum in proportion; the strata are counted first and must be few."""
    counts = {str(r[0]): r[1] for r in df.groupBy(F.col(stratum).cast("string").alias("s")).count().collect()}
    return quota_sample(df.withColumn("__stratum", F.col(stratum).cast("string")), "__stratum", allocate(counts, n), id_col, seed).drop("__stratum")


def group_sample(df: DataFrame, group: str, n: int, seed: int = 42, order: Column | None = None) -> DataFrame:
    """All rows of n groups, the first in hash order or a given one."""
    chosen = df.select(group).distinct().orderBy(hash_order(group, seed=seed) if order is None else order, group).limit(n)
    return df.join(chosen, group, "left_semi")


def balanced_head(df: DataFrame, label: str, n: int, order: str) -> DataFrame:
    """n div (number of classes) rows of every class, the first in the table's order; binary labels."""
    return per_class(df, label, n // 2, [order])


def balanced_by_slice(df: DataFrame, part: str, label: str, most: int, least: int, order: str) -> DataFrame:
    """The same number of rows of both classes per slice, at most ``most``; slices with fewer than ``least`` of a class go."""
    counts = df.groupBy(part).agg(F.least(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0), F.lit(most)).alias("__take")).where(F.col("__take") >= least)
    return per_class(df.join(counts, part), [part, label], F.col("__take"), [order]).drop("__take")


def stratified_split(df: DataFrame, label: str, id_col: str, cuts: list[tuple[str, float]], order: list[Column | str] | None = None) -> DataFrame:
    """Column split: within every label the rows in hash order are cut at the cumulative fractions; the last part takes the rest."""
    w = Window.partitionBy(label)
    place = (F.row_number().over(w.orderBy(*(order or [hash_order(id_col), id_col]))) - 1) / F.count("*").over(w)
    split, total = F.lit(None).cast("string"), 0.0
    tests = []
    for name, share in cuts[:-1]:
        total += share
        tests.append((place < total, name))
    for test, name in reversed(tests):
        split = F.when(test, name).otherwise(split)
    return df.withColumn("split", F.coalesce(split, F.lit(cuts[-1][0])))


def group_split(df: DataFrame, group: str, cuts: list[tuple[str, float]], key: Column | None = None) -> DataFrame:
    """Column split that is the same for all rows of a group, by a hash of the group cut into thousandths."""
    place = F.pmod(key if key is not None else hash_order(group), F.lit(1000)) / 1000
    split, total = F.lit(cuts[-1][0]), sum(share for _, share in cuts[:-1])
    for name, share in reversed(cuts[:-1]):
        split = F.when(place < total, name).otherwise(split)
        total -= share
    return df.withColumn("split", split)


def leaking_groups(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups in more than one split; empty if the split is clean."""
    return df.groupBy(group).agg(F.count_distinct(split).alias("n")).where("n > 1")


def stratified_folds(df: DataFrame, label: str, id_col: str, k: int = 5, order: list[Column | str] | None = None) -> DataFrame:
    """Column fold from 0 to k - 1 that deals every label's rows in turn."""
    w = Window.partitionBy(label).orderBy(*(order or [hash_order(id_col), id_col]))
    return df.withColumn("fold", ((F.row_number().over(w) - 1) % k).cast("int"))


def group_folds(df: DataFrame, group: str, k: int = 5, key: Column | None = None) -> DataFrame:
    """Column fold that is the same for all rows of a group."""
    return df.withColumn("fold", F.pmod(key if key is not None else hash_order(group), F.lit(k)).cast("int"))


def majority_group_split(df: DataFrame, group: str, label: str, cuts: list[tuple[str, float]], order: list[Column | str] | None = None) -> DataFrame:
    """Groups split so that the groups' majority labels (the smaller on ties) are in proportion; rows follow their group."""
    counts = df.groupBy(group, label).agg(F.count("*").alias("__n"))
    of_group = counts.groupBy(group).agg(F.min_by(label, F.struct((-F.col("__n")).alias("n"), F.col(label).alias("l"))).alias("__label"))
    return df.join(stratified_split(of_group, "__label", group, cuts, order).drop("__label"), group)


def anchor_chunks(df: DataFrame, trace: str, chunk: str, traces: int, chunks: int, order: Callable[..., Column] = hash_order) -> DataFrame:
    """Of some traces, the first in hash order, some chunks each, to be compared with anchors."""
    return per_class(group_sample(df, trace, traces, order=order(trace)), trace, chunks, [order(trace, chunk), chunk])


def prefix_split(df: DataFrame, order: str, cuts: list[tuple[str, int]], rest: str) -> DataFrame:
    """Column split by the place of a row in an order of distinct values: the first n rows, the next, and the rest."""
    placed = running_sums(df.withColumn("__one", F.lit(1)), order, ["__one"], [])
    split, end, tests = F.lit(rest), 0, []
    for name, n in cuts:
        end += n
        tests.append((F.col("__one_before") < end, name))
    for test, name in reversed(tests):
        split = F.when(test, name).otherwise(split)
    return placed.withColumn("split", split).drop("__one", "__one_before")
