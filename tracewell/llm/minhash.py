"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A document's signature has ``ROWS`` values of ``BITS`` bits.  Two signatures
within Hamming distance ``MOST_ERRORS`` (values that differ) must, when they
are split into ``CHUNKS`` chunks, agree on some chunk up to
MOST_ERRORS // CHUNKS values, by the pigeonhole principle.  Each chunk is
indexed under every way of leaving that many values out, so an equi-join finds
all pairs within the distance.  At a similarity of 0.8 a signature differs in
12.8 of 64 values on average (standard deviation 3.2); a pair is missed with a
probability of about 1e-7.

Documents with equal sets are one class from the start.  Pairs of classes that
share an index key and lie within the distance form clusters, as forests only.
Inside a cluster the classes are confirmed on their full sets.  Members of a
key or cluster that don't fit one task are dealt into blocks: every block is
compared with the group's first member, and those that aren't near it are
compared with all blocks, so a large group of copies of one text costs about
one comparison a member, and no pair that could add a link is left out.

Defined results: documents without words (null, empty or blank texts) link
with nothing; rows that share an id count as one document in the links, and
each row is returned; rows without an id are linked like others, take the
smallest id they reach as component_id (null if there is none), and are not
kept where there is one; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work
from .graph import components
from .strings import batches_of, shingle_sets

ROWS, BITS = 64, 16
CHUNKS, MOST_ERRORS = 16, 31
#: Similarity of a link as a percentage, and words of a shingle, unless given.
PERCENT, WIDTH = 80, 5
#: Bytes of text whose shingles are hashed at a time.
HASH_BYTES = 1_000_000
#: Members and shingles of a block of a cluster, and members of a block of an index key.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000
KEY_BLOCK = 2048

_SEEDS = np.random.default_rng(20_240_101)
_XOR = _SEEDS.integers(0, 1 << 64, ROWS, np.uint64)
_ODD = _SEEDS.integers(0, 1 << 64, ROWS, np.uint64) | np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ROWS values for each non-empty set of 64-bit hashes."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.zeros((len(sets), ROWS), f"<u{BITS // 8}")
    for k in range(ROWS):
        smallest = np.minimum.reduceat((flat ^ _XOR[k]) * _ODD[k], starts)
        out[:, k] = (smallest * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
    return out


def index_keys(signature: np.ndarray) -> np.ndarray:
    """Keys of signatures (rows): one per chunk and choice of left-out values, all distinct."""
    size, left_out = ROWS // CHUNKS, MOST_ERRORS // CHUNKS
    chunks = signature.reshape(len(signature), CHUNKS, size).astype(np.int64)
    keys = []
    for number, kept in enumerate(combinations(range(size), size - left_out)):
        key = np.arange(CHUNKS, dtype=np.int64)[None, :] * 16 + number
        for k in kept:
            key = key << BITS | chunks[:, :, k]
        keys.append(key)
    return np.concatenate(keys, axis=1)


def describe(docs: DataFrame, *, id_col: str, text_col: str, width: int) -> DataFrame:
    """doc_id, body (a hash of the text where there is no id), n_shingles, class (digest of the set) and signature; the last two null for empty sets."""
    schema = pa.schema([("doc_id", pa.int64()), ("body", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.binary()), ("signature", pa.binary())])

    def run(batches):
        for batch in batches:
            bodies = [b.as_py() or b"" for b in batch.column(2)]
            sizes, classes, signed = [], [], []
            for part in batches_of(bodies, HASH_BYTES):
                sets = shingle_sets(bodies[part], width)
                filled = [s for s in sets if len(s)]
                rows = iter(signatures(filled) if filled else ())
                for s in sets:
                    sizes.append(len(s))
                    classes.append(class_of(s) if len(s) else None)
                    signed.append(next(rows).tobytes() if len(s) else None)
            yield work.batch_of(schema, doc_id=batch.column(0).to_pylist(), body=batch.column(1).to_pylist(), n_shingles=sizes, signature=signed, **{"class": classes})

    return located(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, body bigint, n_shingles bigint, class binary, signature binary")


def located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, body (a hash of the text where there is no id) and text as bytes."""
    id_, text = F.col(id_col).cast("bigint"), F.col(text_col).cast("binary")
    return docs.select(id_.alias("doc_id"), F.when(id_.isNull(), F.xxhash64(text)).alias("body"), text.alias("text"))


def class_of(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def runs(batches, columns: int):
    """Runs of equal first column in batches sorted by it, as arrays."""
    held = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:columns]]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        cuts = [0, *(np.flatnonzero(now[0][1:] != now[0][:-1]) + 1).tolist()]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield [x[a:b] for x in now]
        held = [x[cuts[-1] :] for x in now]
    if held is not None:
        yield held


def shared_keys(classes: DataFrame) -> DataFrame:
    """Rows (key, rep, own) of all index keys that several classes have; own numbers the blocks of a key's classes from 0."""

    def keys(batches):
        for batch in batches:
            if batch.num_rows:
                found = index_keys(np.stack([np.frombuffer(s, f"<u{BITS // 8}") for s in batch.column(1).to_pylist()]))
                reps = np.repeat(batch.column(0).to_numpy(), found.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), pa.array(reps)], names=["key", "rep"])

    def shared(batches):
        waiting = None  # the last row, if nothing is known yet that shares its key
        last, seen = None, 0  # the last key, and how many rows of it came
        for batch in batches:
            if not batch.num_rows:
                continue
            key, rep = (c.to_numpy() for c in batch.columns)
            same = key[1:] == key[:-1]
            before = np.concatenate(([key[0] == last], same))
            keep = before | np.concatenate((same, [False]))
            n = len(before)
            starts = np.flatnonzero(~before)
            place = np.arange(n) - np.concatenate(([-seen], starts))[np.cumsum(~before)]
            last, seen = key[n - 1], int(place[-1]) + 1
            if waiting is not None and before[0]:
                key, rep, keep, place = np.append(key, key[0]), np.append(rep, waiting), np.append(keep, True), np.append(place, 0)
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(rep[keep]), pa.array((place[keep] // KEY_BLOCK).astype(np.int32))], names=["key", "rep", "own"])
            waiting = None if keep[n - 1] else rep[n - 1]

    dealt = classes.select("rep", "signature").mapInArrow(keys, "key bigint, rep bigint").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(shared, "key bigint, rep bigint, own int")


def forest_of(n: int, linked) -> list[tuple[int, int]]:
    """Spanning forest of rows 0 to n - 1; ``linked(i, others)`` says which of some rows i is linked with."""
    fresh = np.arange(n)
    edges = []
    while len(fresh):
        todo, fresh = [int(fresh[0])], fresh[1:]
        while todo and len(fresh):
            i = todo.pop()
            hit = linked(i, fresh)
            found, fresh = fresh[hit], fresh[~hit]
            edges += [(i, j) for j in found.tolist()]
            todo += found.tolist()
    return edges


def _signed(payloads: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(payloads.tolist()), f"<u{BITS // 8}").reshape(len(payloads), ROWS)


def near_signatures(payloads: np.ndarray) -> list[tuple[int, int]]:
    """Forest of the signatures within the distance."""
    rows = _signed(payloads)
    if len(rows) == 2:
        return [(0, 1)] if np.count_nonzero(rows[0] != rows[1]) <= MOST_ERRORS else []
    return forest_of(len(rows), lambda i, others: np.count_nonzero(rows[others] != rows[i], axis=1) <= MOST_ERRORS)


def near_first_signature(payloads: np.ndarray) -> np.ndarray:
    rows = _signed(payloads)
    return np.count_nonzero(rows != rows[0], axis=1) <= MOST_ERRORS


#: Rows that tasks compare, and what they find: an edge, or (v null) a member that isn't near its group's first.
GROUPED = "grp bigint, blocks int, own int, node bigint, payload binary"
FOUND = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def group_edges(rows: DataFrame, forest: Callable[[np.ndarray], list], near_first: Callable[[np.ndarray], np.ndarray], folder: str) -> DataFrame:
    """Edges (u, v) that connect what is near inside each group, without a task that holds a whole large group.

    rows: grp, blocks, own (from 0 to blocks - 1), node, payload.  ``forest`` gives a spanning forest of some
    payloads by place, ``near_first`` which of them are near the first.  Rows of one node in a group are one.
    """

    def compare(batches):
        for _, nodes, payloads in runs(batches, 3):
            first = np.unique(nodes, return_index=True)[1]
            if len(first) > 1:
                nodes, payloads = nodes[first], payloads[first]
                edges = forest(payloads)
                if edges:
                    yield work.batch_of(FOUND, u=[nodes[i] for i, _ in edges], v=[nodes[j] for _, j in edges])

    def star(batches):
        for _, nodes, payloads, _ in runs(batches, 4):
            near = near_first(payloads)
            yield work.batch_of(FOUND, u=np.where(near, nodes[0], nodes), v=[n if k else None for n, k in zip(nodes.tolist(), near.tolist(), strict=True)])

    def tasks(df: DataFrame, *key) -> DataFrame:
        return df.select(F.xxhash64(*key).alias("task"), "node", "payload").repartition("task").sortWithinPartitions("task", "node")

    ddl = "u bigint, v bigint"
    small = tasks(rows.where("blocks = 1"), "grp").mapInArrow(compare, ddl)
    large = work.materialize(rows.where("blocks > 1"), f"{folder}/large")
    if large.isEmpty():
        return small
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own")
    # The first member, the smallest, goes to each block of its group.
    lead = large.groupBy("grp").agg(F.min("node").alias("node"))
    first = large.join(lead, ["grp", "node"], "left_semi").dropDuplicates(["grp"]).select("grp", every, "node", "payload", F.lit(0).alias("after"))
    both = first.unionByName(large.select("grp", "own", "node", "payload", F.lit(1).alias("after")))
    dealt = both.select(F.xxhash64("grp", "own").alias("task"), "node", "payload", "after").repartition("task").sortWithinPartitions("task", "after", "node")
    stars = work.materialize(dealt.mapInArrow(star, ddl), f"{folder}/stars")
    # A member that isn't near the first is compared with all others of its group, block by block.
    far = large.join(stars.where("v is null").select(F.col("u").alias("node")).distinct(), "node", "left_semi")
    far_blocks = far.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("others"))
    other = F.pmod(F.xxhash64("node"), F.col("others")).cast("int").alias("other")
    sides = far.join(far_blocks, "grp").select("grp", every, other, "node", "payload").unionByName(large.join(far_blocks, "grp").select("grp", "own", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"), "node", "payload"))
    crossed = tasks(sides, "grp", "own", "other").mapInArrow(compare, ddl)
    return small.unionByName(stars.where("v is not null and u != v")).unionByName(crossed)


def close_pairs(keyed: DataFrame, folder: str) -> DataFrame:
    """Edges (u, v): of each key's classes a forest of those within the signature distance.  keyed: key, rep, own, signature."""
    large = work.materialize(keyed.where("own > 0").groupBy("key").agg((F.max("own") + 1).alias("blocks")), f"{folder}/sizes")
    sized = keyed.withColumn("blocks", F.lit(1)) if large.isEmpty() else keyed.join(large, "key", "left")
    rows = sized.select(F.col("key").alias("grp"), F.coalesce("blocks", F.lit(1)).alias("blocks"), "own", F.col("rep").alias("node"), F.col("signature").alias("payload"))
    return group_edges(rows, near_signatures, near_first_signature, folder).distinct()


def common_counts(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Matrix of the sizes of all intersections of some sets."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    same = np.concatenate(([False], flat[1:] == flat[:-1]))
    shared = same | np.concatenate((same[1:], [False]))  # hashes of one set only don't count
    flat, owner, same = flat[shared], owner[shared], same[shared]
    column = np.cumsum(~same) - 1
    out = np.zeros((len(sets), len(sets)), np.int64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, (first, first + columns))
        grid = np.zeros((len(sets), columns), np.float32)
        grid[owner[a:b], column[a:b] - first] = 1
        out += (grid @ grid.T).astype(np.int64)
    return out


def similar_sets(payloads: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Forest of the sets that are at least that similar."""
    sets = [np.frombuffer(p, np.uint64) for p in payloads]
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = np.intersect1d(sets[0], sets[1], assume_unique=True).size
        return [(0, 1)] if 100 * both >= percent * (sizes.sum() - both) else []
    both = common_counts(sets)
    linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    return forest_of(len(sets), lambda i, others: linked[i, others])


def similar_to_first(payloads: np.ndarray, percent: int) -> np.ndarray:
    sets = [np.frombuffer(p, np.uint64) for p in payloads]
    both = np.array([np.isin(s, sets[0], assume_unique=True, kind="sort").sum() for s in sets])
    sizes = np.array([len(s) for s in sets])
    return 100 * both >= percent * (sizes + len(sets[0]) - both)


def member_sets(docs: DataFrame, members: DataFrame, *, id_col: str, text_col: str, width: int) -> DataFrame:
    """grp, blocks, own, node and payload (the set) of members: node, class, rep, body, grp, blocks, own.

    Texts are found by id, or by their hash where a class has no id; of rows that share an id those of the class count, once.
    """
    schema = pa.schema([("grp", pa.int64()), ("blocks", pa.int32()), ("own", pa.int32()), ("node", pa.int64()), ("payload", pa.binary())])

    def to_sets(batches):
        done, at = set(), None  # nodes of the current place that have their set
        for batch in batches:
            columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names) if n != "text"}
            bodies = [t.as_py() or b"" for t in batch.column(batch.schema.get_field_index("text"))]
            sets = (s for part in batches_of(bodies, HASH_BYTES) for s in shingle_sets(bodies[part], width))
            rows: list[list] = [[] for _ in schema]
            for place, node, kind, own, *where in zip(*(columns[n] for n in ("place", "node", "class")), sets, *(columns[n] for n in ("grp", "blocks", "own")), strict=True):
                if place != at:
                    done, at = set(), place
                if node not in done and class_of(own) == kind:
                    done.add(node)
                    for values, value in zip(rows, (*where, node, own.tobytes()), strict=True):
                        values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows, schema, strict=True)], schema=schema)

    texts = located(docs, id_col, text_col)
    out = None
    for place, known in (("doc_id", F.col("rep").isNotNull()), ("body", F.col("rep").isNull())):
        wanted = members.where(known).select("grp", "blocks", "own", "node", "class", F.col("rep" if place == "doc_id" else "body").alias("place"))
        found = texts.where(F.col("doc_id").isNotNull() if place == "doc_id" else F.col("doc_id").isNull()).select(F.col(place).alias("place"), "text")
        # Always by a shuffle of both sides: a broadcast of few members would make small and large inputs behave differently.
        sets = wanted.join(found.hint("merge"), "place").mapInArrow(to_sets, GROUPED)
        out = sets if out is None else out.unionByName(sets)
    return out


def confirm(docs: DataFrame, clusters: DataFrame, classes: DataFrame, folder: str, *, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """Edges (u, v) of the classes of each cluster that are similar by their full sets.

    clusters: (node, component); classes: (node, class, rep, body, n_shingles).
    """
    members = clusters.join(classes, "node")
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n_shingles") / F.lit(BLOCK_SHINGLES))).cast("int")
    sizes = members.groupBy("component").agg(blocks.alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = members.join(sizes, "component").select(F.col("component").alias("grp"), "blocks", own.alias("own"), "node", "class", "rep", "body")
    sets = work.materialize(member_sets(docs, dealt, id_col=id_col, text_col=text_col, width=width), f"{folder}/sets")
    return group_edges(sets, lambda p: similar_sets(p, percent), lambda p: similar_to_first(p, percent), folder)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links lead to) and kept, per row of ``docs``.

    Behind them body, a hash of the text of rows without an id, and lead_body, the smallest one of a component without any id.
    """
    folder = work.workspace(docs.sparkSession, "minhash")
    described = work.materialize(describe(docs, id_col=id_col, text_col=text_col, width=width), f"{folder}/documents")
    distinct = described.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("rep"), F.min(F.when(F.col("doc_id").isNull(), F.col("body"))).alias("body"), F.max("n_shingles").alias("n_shingles"), F.min("signature").alias("signature"))
    # A class is a node of its own, whatever ids its rows have; the numbers are written once and read from then on.
    classes = work.materialize(distinct.withColumn("node", F.monotonically_increasing_id()), f"{folder}/classes")
    named = classes.select(F.col("node").alias("rep"), "signature")
    keyed = work.materialize(shared_keys(named).join(named.hint("merge"), "rep"), f"{folder}/keyed")
    clusters = work.materialize(components(close_pairs(keyed, f"{folder}/keys"), f"{folder}/clusters"), f"{folder}/members")
    edges = confirm(docs, clusters, classes.drop("signature"), folder, id_col=id_col, text_col=text_col, width=width, percent=percent)
    # Different texts under one id are one document.
    several = described.where("class is not null and doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64("class")).alias("a"), F.max(F.xxhash64("class")).alias("b")).where("a != b").select("doc_id")
    nodes = described.join(several, "doc_id", "left_semi").select("doc_id", "class").distinct().join(classes.select("class", "node"), "class")
    same_id = nodes.join(nodes.groupBy("doc_id").agg(F.min("node").alias("u")), "doc_id").select("u", F.col("node").alias("v"))
    linked = work.materialize(components(edges.unionByName(same_id), f"{folder}/links"), f"{folder}/linked")
    leads = classes.join(linked, "node").groupBy("component").agg(F.min("rep").alias("lead"), F.min("body").alias("lead_body"))
    of_node = linked.join(leads, "component").select("node", "lead", "lead_body")
    lead = classes.join(of_node, "node", "left").select("class", F.coalesce("lead", "rep").alias("found"), F.coalesce("lead_body", "body").alias("lead_body"))
    component = F.coalesce("found", "doc_id")
    joined = described.join(lead, "class", "left")
    kept = F.coalesce(F.col("doc_id") == component, component.isNull())
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "body", F.when(component.isNull(), F.col("lead_body")).alias("lead_body"))
