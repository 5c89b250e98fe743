"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, one for each half of the vectors, form a grid of cells.  A vector
lies in the cell of its nearest codewords.  To be nearer to a codeword than to
its own, a vector must be moved at least to the plane between the two; that is
a lower bound of how far a partner in another cell is.  A multi-sequence
traversal visits a vector's cells in the order of these bounds and stops at
the largest distance a link can have, so the target recall is 1 and every pair
met in a cell is verified by its cosine in double precision.  Cells of one first
codeword and ``ROW_CELLS`` second ones are stored together: a vector is sent once
to each such row of the grid that it visits, with a mask of the cells in it.

Codewords grow with the square root of the vectors, so that the vectors compared
with one grow more slowly than all vectors do.  The codebooks are fitted on a
sample of at most ``SAMPLE`` vectors; every vector is indexed and every vector is
a query.  Equal vectors of a label are one
class with a count.  A cell's members and queries are cut into blocks, and a
task verifies one block of each, so a crowded cell is split.

Defined results: vectors that are null, zero, or hold null or non-finite
components, and those without a label, link with nothing; vectors are only
compared with those of the same length; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work
from .graph import components
from .minhash import forest_of, runs

COSINE = 0.98
#: Fewest codewords of a half, vectors they serve, vectors codewords are fitted on (at least FITTED for each), and rounds of fitting.
CODEWORDS, SERVED = 16, 50_000
SAMPLE, FITTED = 20_000, 8
ROUNDS = 12
#: Cells of a row of the grid, bits of a mask.
ROW_CELLS = 62
#: Nearest codewords that bounds are taken from, and numbers held at a time while cells are visited.
NEAREST, HELD = 16, 4_000_000
#: Members of a block of a cell.
BLOCK = 2048


def packed(vector: list | None, label) -> bytes | None:
    """A vector as bytes, in single precision where that loses nothing; null where it takes no part."""
    if label is None or not vector or None in vector:
        return None
    x = np.array(vector, np.float64)
    if not np.isfinite(x).all() or not x.any():
        return None
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    return b"f" + short.tobytes() if (short == x).all() else b"d" + x.tobytes()


def unit(data: bytes) -> np.ndarray:
    """A packed vector as a unit vector in double precision."""
    x = np.frombuffer(data, np.float32 if data[:1] == b"f" else np.float64, offset=1).astype(np.float64)
    x = x / np.abs(x).max()
    return x / np.sqrt(x @ x)


def fit(sample: np.ndarray, codewords: int = CODEWORDS, rounds: int = ROUNDS) -> np.ndarray:
    """Codewords of a half by k-means, started from points far from each other."""
    centres = sample[:1]
    far = _distances(sample, centres)[:, 0]
    while len(centres) < min(codewords, len(sample)) and far.max() > 1e-12:
        new = sample[[int(far.argmax())]]
        centres = np.concatenate((centres, new))
        far = np.minimum(far, _distances(sample, new)[:, 0])
    for _ in range(rounds):
        own = _distances(sample, centres).argmin(axis=1)
        centres = np.stack([sample[own == k].mean(axis=0) if (own == k).any() else centres[k] for k in range(len(centres))])
    return np.unique(centres, axis=0)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum(0, (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None] - 2 * x @ centres.T)


def bounds(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of each row, and squared lower bounds of the distance to any point of each codeword's cell."""
    near = _distances(x, centres)
    apart = np.sqrt(_distances(centres, centres))
    # Half the inverse of the distance between codewords; very close ones give no bound.
    half = np.divide(0.5, apart, out=np.zeros_like(apart), where=apart >= 1e-6)
    nearest = np.argpartition(near, min(NEAREST, len(centres)) - 1, axis=1)[:, :NEAREST]
    out = np.zeros_like(near)
    for a in nearest.T:
        # Distance to the plane between codeword a and each other one, of which a is the nearer.
        out = np.maximum(out, (near - np.take_along_axis(near, a[:, None], axis=1)) * half[a])
    return near.argmin(axis=1), out**2


def multi_sequence(first: np.ndarray, second: np.ndarray, most: float):
    """Cells (query, i, j) in ascending order of first[query, i] + second[query, j], as long as the sum is at most ``most``.

    All queries take a step at a time, so arrays of one cell of each query are given.  ``front`` holds a query's next sum
    for every first codeword; the least of them is the next cell.
    """
    rows = np.flatnonzero(first.min(axis=1) + second.min(axis=1) <= most)
    a, b = np.argsort(first[rows], axis=1, kind="stable"), np.argsort(second[rows], axis=1, kind="stable")
    x, y = np.take_along_axis(first[rows], a, axis=1), np.take_along_axis(second[rows], b, axis=1)
    width = int((x + y[:, :1] <= most).sum(axis=1).max(initial=0))
    x, y = x[:, :width], np.pad(y, ((0, 0), (0, 1)), constant_values=np.inf)
    front, at = x + y[:, :1], np.zeros(x.shape, np.int64)
    while len(rows):
        i = front.argmin(axis=1)
        going = np.flatnonzero(front[np.arange(len(rows)), i] <= most)
        if len(going) < 0.75 * len(rows):
            rows, a, b, x, y, front, at, i = (z[going] for z in (rows, a, b, x, y, front, at, i))
            going = np.arange(len(rows))
        i = i[going]
        j = at[going, i]
        yield rows[going], a[going, i], b[going, j]
        at[going, i] = j + 1
        front[going, i] = x[going, i] + y[going, j + 1]


def _vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, class (digest of the unit vector) and vector; the last two null where a vector takes no part."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("class", pa.binary()), ("vector", pa.binary())])

    def run(batches):
        for batch in batches:
            labels = batch.column(1).to_pylist()
            found = [packed(v, label) for v, label in zip(batch.column(2).to_pylist(), labels, strict=True)]
            classes = [v and hashlib.blake2b(unit(v).tobytes(), digest_size=16).digest() for v in found]
            yield work.batch_of(schema, vec_id=batch.column(0).to_pylist(), label=labels, vector=found, **{"class": classes})

    return vectors.select(F.col(id_col).cast("bigint"), F.col(label_col).cast("string"), F.col(vector_col)).mapInArrow(run, "vec_id bigint, label string, class binary, vector binary")


def codewords_for(vectors: int) -> int:
    """Codewords of a half: as the square root of the vectors, and no more than the sample can fit."""
    return min(max(CODEWORDS, round(CODEWORDS * (vectors / SERVED) ** 0.5)), SAMPLE // FITTED)


def codebooks(classes: DataFrame, size: int = SAMPLE, codewords: int | None = None) -> tuple[int, list[np.ndarray]]:
    """Length of most vectors of the sample, and the codewords of their two halves."""
    codewords = codewords or codewords_for(classes.count())
    sample = [unit(bytes(r[0])) for r in classes.orderBy(F.xxhash64("rep"), "rep").limit(size).select("vector").collect()]
    if not sample:
        return 0, []
    length = int(np.bincount([len(x) for x in sample]).argmax())
    x = np.stack([v for v in sample if len(v) == length])
    return length, [fit(x[:, : length // 2], codewords), fit(x[:, length // 2 :], codewords)]


def visits(classes: DataFrame, length: int, books: list[np.ndarray], cosine: float) -> DataFrame:
    """Rows (place, query, rep, n, vector, cells): each class in its own cell's row of the grid, and as a query in every row a link may lead to.

    cells is a mask over the second codewords of the row.
    """
    most = 2 - 2 * cosine + 1e-9
    schema = pa.schema([("place", pa.string()), ("query", pa.bool_()), ("rep", pa.int64()), ("n", pa.int64()), ("vector", pa.binary()), ("cells", pa.int64())])

    def run(batches):
        for batch in batches:
            rows: dict[str, list] = {f.name: [] for f in schema}

            def add(*values, rows=rows):
                for own, value in zip(rows.values(), values, strict=True):
                    own.append(value)

            reps, ns, labels, vectors = (c.to_pylist() for c in batch.columns)
            x = [unit(v) for v in vectors]
            usual = [i for i, v in enumerate(x) if len(v) == length > 1]
            for i in sorted(set(range(len(x))) - set(usual)):  # other lengths: one cell for each
                for query in (False, True):
                    add(f"{labels[i]}/{len(x[i])}", query, reps[i], ns[i], vectors[i], 1)
            parts = (len(books[1]) - 1) // ROW_CELLS + 1 if usual else 1
            step = max(1, HELD // (len(books[0]) * parts)) if usual else 1
            for some in (usual[k : k + step] for k in range(0, len(usual), step)):
                grid = np.stack([x[i] for i in some])
                own1, low1 = bounds(grid[:, : length // 2], books[0])
                own2, low2 = bounds(grid[:, length // 2 :], books[1])
                masks = np.zeros((len(some), len(books[0]), parts), np.int64)
                for k, a, b in multi_sequence(low1, low2, most):
                    masks[k, a, b // ROW_CELLS] |= np.int64(1) << (b % ROW_CELLS)
                for i, a, b in zip(some, own1.tolist(), own2.tolist(), strict=True):
                    add(f"{labels[i]}/{length}/{a}/{b // ROW_CELLS}", False, reps[i], ns[i], vectors[i], 1 << b % ROW_CELLS)
                visited = np.nonzero(masks)
                for k, a, b, mask in zip(*(z.tolist() for z in (*visited, masks[visited])), strict=True):
                    add(f"{labels[some[k]]}/{length}/{a}/{b}", True, reps[some[k]], ns[some[k]], vectors[some[k]], mask)
            yield work.batch_of(schema, **rows)

    return classes.select("rep", "n", "label", "vector").mapInArrow(run, "place string, query boolean, rep bigint, n bigint, vector binary, cells bigint")


def verified(visited: DataFrame, cosine: float, block: int = BLOCK) -> DataFrame:
    """Rows (rep, links, u, v): links a query has in a block of a row of the grid, and forest edges of the pairs found."""
    blocks = lambda side: F.greatest(F.ceil(F.count_if(F.col("query") == F.lit(side)) / F.lit(block)), F.lit(1)).cast("int")
    sizes = visited.groupBy("place").agg(blocks(True).alias("query_blocks"), blocks(False).alias("own_blocks"), F.count_if(~F.col("query")).alias("own")).where("own > 0").drop("own")
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("query"), F.col("query_blocks")).otherwise(F.col("own_blocks"))).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.when(F.col("query"), F.col("own_blocks")).otherwise(F.col("query_blocks")) - 1))
    dealt = visited.join(sizes, "place").select("*", own.alias("mine"), others.alias("other"))
    task = F.xxhash64("place", F.when(F.col("query"), F.col("mine")).otherwise(F.col("other")), F.when(F.col("query"), F.col("other")).otherwise(F.col("mine")))
    tasks = dealt.select(task.alias("task"), "query", "rep", "n", "vector", "cells").repartition("task").sortWithinPartitions("task", "query", "rep")
    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        for _, query, rep, n, vector, cells in runs(batches, 6):
            query = query.astype(bool)
            if query.all() or not query.any():
                continue
            x, y = (np.stack([unit(v) for v in vector[side]]) for side in (query, ~query))
            asks, owns, wanted, cell, weight = rep[query], rep[~query], cells[query], cells[~query], n[~query].astype(np.int64)
            links = np.zeros(len(asks), np.int64)
            edges = []
            for mask in np.unique(cell):  # a cell with the queries that visit it
                rows, columns = np.flatnonzero(wanted & mask), np.flatnonzero(cell == mask)
                if not len(rows):
                    continue
                linked = (x[rows] @ y[columns].T >= cosine) & (asks[rows][:, None] != owns[columns][None])
                links[rows] += linked @ weight[columns]
                some, hit = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
                if len(some):  # forest of the two-sided graph: queries first, then members
                    both = np.zeros((len(some) + len(hit),) * 2, bool)
                    both[: len(some), len(some) :] = linked[np.ix_(some, hit)]
                    both[len(some) :, : len(some)] = both[: len(some), len(some) :].T
                    nodes = np.concatenate((asks[rows][some], owns[columns][hit]))
                    edges += [(nodes[i], nodes[j]) for i, j in forest_of(len(both), lambda i, others: both[i, others])]
            found = np.flatnonzero(links)
            none = [None] * len(edges)
            yield work.batch_of(schema, rep=[*asks[found].tolist(), *none], links=[*links[found].tolist(), *none], u=[None] * len(found) + [u for u, _ in edges], v=[None] * len(found) + [v for _, v in edges])

    return tasks.mapInArrow(run, "rep bigint, links bigint, u bigint, v bigint")


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id (the smallest id that links lead to) and kept, per row."""
    folder = work.workspace(vectors.sparkSession, "vectors")
    units = work.materialize(_vectors(vectors, id_col, vector_col, label_col), f"{folder}/vectors")
    classes = work.materialize(units.where("class is not null").groupBy("label", "class").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.min("vector").alias("vector")), f"{folder}/classes")
    length, books = codebooks(classes)
    visited = work.materialize(visits(classes, length, books, cosine), f"{folder}/visits")
    found = work.materialize(verified(visited, cosine), f"{folder}/found")
    links = found.where("rep is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    linked = components(found.where("u is not null").select("u", "v"), f"{folder}/links").withColumnRenamed("node", "rep")
    of_class = classes.select("label", "class", "rep", "n").join(links, "rep", "left").join(linked, "rep", "left")
    told = of_class.select("label", "class", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("found"))
    joined = units.select("vec_id", "label", "class").join(told, ["label", "class"], "left")
    component = F.coalesce("found", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
