"""Periodic runs of words, by refining classes of equal factors (Crochemore).

Positions of a text are in one class at length m if the m words from each are
the same.  Lengths grow by one: a class splits by the classes of its positions'
successors, and of the parts of a class all but the largest are looked at to
split others (the smaller-half rule), so a position is handled a logarithmic
number of times.  Two neighbours of a class at length q that are q words apart
start and halve a square of primitive root; squares of one period at successive
places merge into a run.

The first lengths, at which nearly all positions of prose become single, are
refined for many texts at a time with NumPy; what is left goes on text by text
with linked lists.  A text is one row, and its work is n log n in its words.

Words are the longest runs without the bytes 0x20 and 0x09 to 0x0D.

Defined results: a null text has no words, like an empty one; rows are looked
at one by one, whether ids repeat or are null; an empty table gives an empty
one; the table's further columns may have any names, as they are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import strings, work

#: A run has this many words at least, and twice its period.
LEAST_RUN = 12
#: Lengths that are refined for many texts at a time, and bytes of such texts.
JOINT_LENGTHS, JOINT_BYTES = 6, 4_000_000

RUNS_DDL = "id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


class Factors:
    """Classes of the positions of one text that share a factor with another position, in linked lists by class."""

    def __init__(self, length: int, n: int, shared: list[int], classes: list[int]):
        self.length, self.limit = length, n // 2
        # Class of a position, or ~position where it is alone; neighbours in the class, or -1.
        self.of = [~i for i in range(n + 1)]
        self.next, self.before = [-1] * n, [-1] * n
        self.size: dict[int, int] = {}
        self.head: dict[int, int] = {}
        #: Distance -> positions whose neighbour has been so far away at some time.
        self.apart: dict[int, list[int]] = {}
        last: dict[int, int] = {}
        for i, c in zip(shared, classes, strict=True):
            self.of[i] = c
            self.size[c] = self.size.get(c, 0) + 1
            if c in last:
                self._link(last[c], i)
            else:
                self.head[c] = i
            last[c] = i
        self.fresh = max(self.size, default=0) + 1
        self.small = [i + 1 for i in shared]

    def _link(self, a: int, b: int) -> None:
        self.next[a], self.before[b] = b, a
        if b - a <= self.limit:
            self.apart.setdefault(b - a, []).append(a)

    def squares(self) -> list[int]:
        """Starts of the squares whose half has the present length."""
        return sorted({i for i in self.apart.pop(self.length, ()) if self.next[i] == i + self.length})

    def _leave(self, c: int, members: list[int]) -> None:
        """Take members out of class c and make them one of their own."""
        for i in members:
            a, b = self.before[i], self.next[i]
            if a < 0:
                self.head[c] = b
            else:
                self.next[a] = -1
            if b >= 0:
                self.before[b] = -1
                if a >= 0:
                    self._link(a, b)
            self.before[i] = self.next[i] = -1
        self.size[c] -= len(members)
        if len(members) == 1:
            self.of[members[0]] = ~members[0]
            return
        new = self.fresh
        self.fresh += 1
        self.size[new], self.head[new] = len(members), members[0]
        for i in members:
            self.of[i] = new
        for a, b in zip(members, members[1:], strict=False):
            self._link(a, b)

    def refine(self) -> None:
        """Go to the next length."""
        of, size = self.of, self.size
        parts: dict[int, dict[int, list[int]]] = {}
        for i in self.small:
            c = of[i - 1]
            if i and c >= 0:
                parts.setdefault(c, {}).setdefault(of[i], []).append(i - 1)
        small: list[int] = []
        for c, by in parts.items():
            groups = sorted(by.values(), key=len)
            rest = size[c] - sum(map(len, groups))
            if rest == 0 and len(groups) == 1:
                continue
            largest = groups.pop() if rest == 0 else None
            for members in groups:
                self._leave(c, members)
            if rest and rest < len(groups[-1]):
                groups.pop()
                i = self.head[c]
                while i >= 0:
                    small.append(i)
                    i = self.next[i]
            for members in groups:
                small.extend(members)
            if size[c] == 1:
                alone = largest[0] if largest else self.head[c]
                of[alone] = ~alone
        self.small = small
        self.length += 1


def squares(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Periods and starts of the primitive squares of many texts.

    ``ids`` has the words of each text as numbers that no other text has, and after each text one that occurs once.
    """
    periods: list[np.ndarray] = []
    places: list[np.ndarray] = []
    _, of, sizes = np.unique(ids, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(sizes[of] > 1)
    length, fresh = 1, len(sizes)
    while len(shared) and length < JOINT_LENGTHS:
        order = shared[np.argsort(of[shared], kind="stable")]
        near = (of[order[1:]] == of[order[:-1]]) & (order[1:] - order[:-1] == length)
        places.append(order[:-1][near])
        periods.append(np.full(int(near.sum()), length))
        _, part, sizes = np.unique(of[shared] * fresh + of[shared + 1], return_inverse=True, return_counts=True)
        of[shared] = fresh + part
        fresh += len(sizes)
        shared, length = shared[sizes[part] > 1], length + 1
    cuts = np.searchsorted(shared, starts), np.searchsorted(shared, starts + counts)
    for text in np.flatnonzero(cuts[1] > cuts[0]).tolist():
        own, base = shared[cuts[0][text] : cuts[1][text]], int(starts[text])
        _, classes = np.unique(of[own], return_inverse=True)
        factors = Factors(length, int(counts[text]), (own - base).tolist(), classes.tolist())
        while factors.small and factors.length <= factors.limit:
            found = factors.squares()
            if found:
                places.append(np.array(found, np.int64) + base)
                periods.append(np.full(len(found), factors.length))
            factors.refine()
    empty = np.zeros(0, np.int64)
    return np.concatenate([*periods, empty]), np.concatenate([*places, empty])


def runs(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray, least: int = LEAST_RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of the runs of many texts, by start, then period."""
    period, place = squares(ids, starts, counts)
    order = np.lexsort((place, period))
    period, place = period[order], place[order]
    first = np.ones(len(place), bool)
    first[1:] = (period[1:] != period[:-1]) | (place[1:] != place[:-1] + 1)
    begin = np.flatnonzero(first)
    squares_of = np.diff(np.append(begin, len(place)))
    start, q = place[begin], period[begin]
    length = squares_of - 1 + 2 * q
    keep = length >= np.maximum(least, 2 * q)
    start, length, q = start[keep], length[keep], q[keep]
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def _look(ids: list[int | None], bodies: list[bytes], least: int) -> pa.RecordBatch:
    words = [body.split() for body in bodies]
    numbers: list[int] = []
    fresh = 0
    for own in words:
        known: dict[bytes, int] = {}
        numbers.extend([known.setdefault(w, fresh + len(known)) for w in own])
        numbers.append(fresh + len(known))
        fresh += len(known) + 1
    counts = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(counts + 1) - counts - 1
    start, length, q = runs(np.array(numbers, np.int64), starts, counts, least)
    # Words after the first period of a run are dropped.
    steps = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(steps, start + q, 1)
    np.add.at(steps, start + length, -1)
    dropped = np.cumsum(steps) > 0
    text = np.searchsorted(starts, start, "right") - 1
    bounds = np.searchsorted(text, np.arange(len(words) + 1))
    found, collapsed = [], []
    for k, own in enumerate(words):
        a, b = int(bounds[k]), int(bounds[k + 1])
        base = int(starts[k])
        found.append([{"start": s - base, "length": n, "period": p} for s, n, p in zip(start[a:b].tolist(), length[a:b].tolist(), q[a:b].tolist(), strict=True)])
        kept = own if a == b else [w for w, gone in zip(own, dropped[base : base + len(own)].tolist(), strict=True) if not gone]
        collapsed.append(b" ".join(kept).decode())
    return work.batch_of(_SCHEMA, id=ids, n_words=counts.tolist(), runs=found, collapsed=collapsed)


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_RUN) -> DataFrame:
    """Per row: id, n_words, its runs (start, length, period; by start, then period) and the text without their repetitions.

    A word is left out of ``collapsed`` if some run has it after that run's first period; the others are joined by spaces.
    """
    work.workspace(docs.sparkSession, "periodic")

    def look(batches):
        for batch in batches:
            ids, bodies = batch.column(0).to_pylist(), [b or b"" for b in batch.column(1).to_pylist()]
            for part in strings.batches_of(bodies, JOINT_BYTES):
                yield _look(ids[part], bodies[part], least)

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("body")).mapInArrow(look, RUNS_DDL)


def with_planted_period(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text, of which a tenth, chosen by the hash of the id, goes on with a period from some word on.

    With h = crc32(decimal id) and g = h div 10: if h % 10 = 0, each word i >= a of n becomes word a + (i - a) % p, where
    a = g % n and p = 1 + (n - a) div (3 + g % 8).  A row without an id stays as it is.
    """
    gap = F.lit(" \t\n\x0b\f\r")
    body = F.btrim(F.coalesce(F.col(text_col), F.lit("")), gap)
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    chosen = F.coalesce((h % 10 == 0) & (body != ""), F.lit(False))
    df = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.floor(h / 10).cast("bigint").alias("__g"), F.when(chosen, F.split(body, r"[\x20\x09-\x0D]+", -1)).alias("__words"))
    n, g = F.size("__words").cast("bigint"), F.col("__g")
    df = df.select("doc_id", "text", "__words", "__g", (g % n).cast("int").alias("__a"))
    df = df.select("doc_id", "text", "__words", "__a", (F.floor((n - F.col("__a")) / (3 + g % 8)) + 1).cast("int").alias("__p"))
    a, p, i = F.col("__a"), F.col("__p"), F.size("__words") - 1

    def word(k: Column) -> Column:
        return F.get(F.col("__words"), F.when(k < a, k).otherwise(a + (k - a) % p))

    planted = F.array_join(F.transform(F.sequence(F.lit(0), i), word), " ")
    return df.select("doc_id", F.when(F.col("__words").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """Runs of the documents with planted periods: their number, the longest one and digests of all runs and of the collapsed text."""
    found = periodic_runs(with_planted_period(docs))
    # The longest run, of equal ones the first and then that of the smallest period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    named = found.select("id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return named.select(F.col("id").alias("doc_id"), "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("bigint").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
