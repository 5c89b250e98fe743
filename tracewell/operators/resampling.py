"""Bootstraps whose rows never are multiplied by the resamples.

Each row has a weight per resample, as if it were drawn a Poisson(1) number of
times; on average a resample has as many draws as there are rows.  Weights
follow from a row's number and the resample by integer arithmetic that any
engine can repeat.  Rows are dealt by ranges of their score, a range adds up
its weights as arrays with a place per resample, and ranges are joined by their
sums, so no task sees more than a range.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .statistics import value_range

MODULUS = 2_147_483_647
#: Rows of a range, about.
RANGE_ROWS = 20_000
#: Rows whose weights are held at once.
WEIGHED_ROWS = 4_000


def poisson_cuts(most: int = 9) -> list[int]:
    """Numbers below MODULUS at which a draw's weight goes up by one: its distribution function, of mean 1, up to ``most``."""
    total, cuts = 0.0, []
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        cuts.append(int(total * MODULUS))
    return cuts


def mixed(row: np.ndarray, resample: np.ndarray, seed: int = 42) -> np.ndarray:
    """A number below MODULUS for each pair; rows are numbered below MODULUS."""
    x = (row * 48_271 + resample * 1_103_515_245 + seed) % MODULUS
    for _ in range(2):
        x = x * 16_807 % MODULUS
        x = (x ^ (x >> 13)) % MODULUS
    return x * 48_271 % MODULUS


def weights(rows: np.ndarray, resamples: int, seed: int = 42) -> np.ndarray:
    """Weights of rows (by number) in each resample."""
    x = mixed(rows[:, None] % MODULUS, np.arange(resamples)[None, :], seed)
    return np.searchsorted(np.array(poisson_cuts()), x.ravel(), "right").reshape(x.shape)


def weighted_auc_interval(df: DataFrame, target: str, score: str, number: str, group: list[str], resamples: int = 1000, low: float = 0.025, high: float = 0.975, seed: int = 42) -> DataFrame:
    """Per group the resamples that have both classes, and the mean and percentile interval of their AUC.

    ``number`` is an integer of the row; rows of one number share their weights, over groups too.
    """
    full = df.where(F.col(score).isNotNull() & F.col(target).isNotNull()).select(*group, F.col(target).cast("int").alias("__y"), F.col(score).cast("double").alias("__s"), F.col(number).cast("bigint").alias("__i"))
    n = full.count()
    if not n:
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in full.select(*group).schema)
        return df.sparkSession.createDataFrame([], f"{kinds}, resamples bigint, mean double, low double, high double")
    ranged = full.withColumn("__range", value_range(full, "__s", max(2, min(4096, -(-n // RANGE_ROWS)))))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.select(*group, "__range").schema)
    k = len(group)

    def add(table: pa.Table) -> pa.Table:
        y, s, i = (table.column(c).to_numpy() for c in ("__y", "__s", "__i"))
        order = np.argsort(s, kind="stable")
        cell = np.concatenate([[0], np.cumsum(np.diff(s[order]) != 0)]) if len(order) else np.zeros(0, int)
        before, won, positives = np.zeros(resamples), np.zeros(resamples), np.zeros(resamples)
        # A few thousand rows at a time; the last score of them stays open, as its rows may go on.
        open_p, open_q = np.zeros(resamples), np.zeros(resamples)
        for at in range(0, len(order), WEIGHED_ROWS):
            part = slice(at, at + WEIGHED_ROWS)
            own = order[part]
            w, up = weights(i[own], resamples, seed).astype(float), y[own] == 1
            starts = np.flatnonzero(np.diff(cell[part], prepend=-1))
            pos, neg = np.add.reduceat(w * up[:, None], starts, 0), np.add.reduceat(w * ~up[:, None], starts, 0)
            if at and cell[at] == cell[at - 1]:
                pos[0] += open_p
                neg[0] += open_q
            else:
                won += open_p * (before + open_q / 2)
                positives += open_p
                before += open_q
            open_p, open_q, pos, neg = pos[-1], neg[-1], pos[:-1], neg[:-1]
            below = before + np.cumsum(neg, 0) - neg
            won += (pos * (below + neg / 2)).sum(0)
            positives += pos.sum(0)
            before += neg.sum(0)
        won += open_p * (before + open_q / 2)
        positives += open_p
        before += open_q
        head = [table.column(c).slice(0, 1) for c in [*group, "__range"]]
        return pa.table([*head, *(pa.array([v.tolist()], pa.list_(pa.float64())) for v in (positives, before, won))], names=[*group, "__range", "p", "q", "w"])

    sums = ranged.groupBy(*group, "__range").applyInArrow(add, f"{kinds}, p array<double>, q array<double>, w array<double>")

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("__range")
        p, q, w = (np.stack([np.array(v) for v in table.column(c).to_pylist()]) for c in ("p", "q", "w"))
        # A range's positives also win against the negatives of all ranges below.
        won = w.sum(0) + (p * (np.cumsum(q, 0) - q)).sum(0)
        all_p, all_q = p.sum(0), q.sum(0)
        fine = (all_p > 0) & (all_q > 0)
        x = won[fine] / (all_p[fine] * all_q[fine])
        cut = np.quantile(x, [low, high]).tolist() if len(x) else [None, None]
        values = [[int(fine.sum())], [float(x.mean()) if len(x) else None], [cut[0]], [cut[1]]]
        return pa.table([*(table.column(j).slice(0, 1) for j in range(k)), *(pa.array(v, t) for v, t in zip(values, (pa.int64(), *[pa.float64()] * 3), strict=True))], names=[*group, "resamples", "mean", "low", "high"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in full.select(*group).schema)
    return sums.groupBy(*group).applyInArrow(join, f"{names}, resamples bigint, mean double, low double, high double")


def weighted_mean_interval(df: DataFrame, value: str, number: str, resamples: int = 1000, low: float = 0.025, high: float = 0.975, seed: int = 42) -> DataFrame:
    """One row: resamples, mean and percentile interval of a column's mean, and the share of resamples whose mean isn't positive.

    Give the difference of two columns for a paired bootstrap.  Tasks add up their rows as arrays with a place per resample.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(number).cast("bigint").alias("i"), F.col(value).cast("double").alias("v"))

    def add(batches):
        sums = np.zeros((2, resamples))
        for batch in batches:
            i, v = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for at in range(0, len(i), WEIGHED_ROWS):
                w = weights(i[at : at + WEIGHED_ROWS], resamples, seed)
                sums += np.stack([v[at : at + WEIGHED_ROWS] @ w, w.sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array([s.tobytes()], pa.binary()) for s in sums], names=["a", "b"])

    def join(batches):
        parts = [r for batch in batches for r in batch.to_pylist()]
        a, b = (sum((np.frombuffer(r[k], float) for r in parts), np.zeros(resamples)) for k in ("a", "b"))
        x = a[b > 0] / b[b > 0]
        cut = np.quantile(x, [low, high]).tolist() if len(x) else [None, None]
        row = [len(x), float(x.mean()) if len(x) else None, *cut, float((x <= 0).mean()) if len(x) else None]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), *[pa.float64()] * 4), strict=True)], names=["resamples", "mean", "low", "high", "p_one_tailed"])

    # A row of two arrays per task meets in one task, by a shuffle: the rows themselves are added up where they are read.
    return rows.mapInArrow(add, "a binary, b binary").repartition(1).mapInArrow(join, "resamples bigint, mean double, low double, high double, p_one_tailed double")


def mixed_column(row: Column, resample: Column, seed: int = 42) -> Column:
    """The same number as an expression."""
    x = ((row.cast("bigint") % MODULUS) * 48_271 + resample.cast("bigint") * 1_103_515_245 + seed) % MODULUS
    for _ in range(2):
        x = x * 16_807 % MODULUS
        x = x.bitwiseXOR(F.shiftright(x, 13)) % MODULUS
    return x * 48_271 % MODULUS


def mixed_sql(row: str, resample: str, seed: int = 42) -> str:
    """The same number in SQL."""
    x = f"((({row}) % {MODULUS}) * 48271::BIGINT + ({resample}) * 1103515245::BIGINT + {seed}) % {MODULUS}"
    for _ in range(2):
        x = f"(({x}) * 16807 % {MODULUS})"
        x = f"(xor({x}, {x} >> 13) % {MODULUS})"
    return f"({x} * 48271 % {MODULUS})"


def weight_sql(seed: int = 42) -> str:
    """The weight of row i in resample b in SQL."""
    return f"(SELECT count(*) FROM (VALUES {', '.join(f'({c})' for c in poisson_cuts())}) c(cut) WHERE {mixed_sql('i', 'b', seed)} >= cut)"
