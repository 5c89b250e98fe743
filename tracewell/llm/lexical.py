"""Ranked lexical search over impact-ordered postings, score at a time.

1. ``index`` writes shards of documents to shared storage: the terms of a shard
   with their document counts, and their postings (document, occurrences).  No
   posting is shuffled.
2. Queries are written as blocks.  Every shard counts a block's terms; the sums
   over all shards give the terms' weights, which are stored with the block.
3. A task takes one shard and one block.  A posting's impact is exact: an
   integer from the term's weight, its occurrences and the document's length.
   Postings are grouped by impact and read from the highest down, over all terms
   of a query at once.  The sum of the next impacts bounds what a document can
   still gain.  Reading stops only when no document outside a few candidates can
   reach the k-th place, and the candidates' scores are completed by a look into
   the postings by document.  Where ties leave more candidates, all is read.
4. The k best of each shard meet in one window per query, limited before the
   shuffle.

Terms are the longest runs of letters and digits of ASCII, of which A-Z are
lower-cased, and of all characters beyond it.

Defined results: a null or termless text counts nowhere and is never found;
queries without terms give no rows; each row of the queries is ranked on its
own, also if ids repeat; of documents with equal scores those with smaller ids
come first, rows without an id last; empty tables give an empty one; further
columns are not read and may have any names.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks, work

#: Bytes of text in a shard of documents and in a block of queries.
SHARD_BYTES, QUERY_BYTES = 24_000_000, 250_000
#: Candidates per place whose scores are completed after reading stops.
CANDIDATES = 4

# Bytes that end a term, and lower-casing of A-Z.
_TERM = bytearray(b" " * 128 + bytes(range(128, 256)))
_TERM[0x30:0x3A] = bytes(range(0x30, 0x3A))
_TERM[0x41:0x5B] = bytes(range(0x61, 0x7B))
_TERM[0x61:0x7B] = bytes(range(0x61, 0x7B))
_TERM = bytes(_TERM)

_SHARD = pa.schema([("uri", pa.string()), ("head", pa.int64()), ("documents", pa.int64()), ("terms", pa.int64())])
_SHARD_DDL = "uri string, head bigint, documents bigint, terms bigint"
_FOUND = pa.schema([("block", pa.int64()), ("place", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
_FOUND_DDL = "block bigint, place bigint, item_id bigint, doc_id bigint, score bigint"


def terms_of(body: bytes) -> list[bytes]:
    return body.translate(_TERM).split()


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class _Writer:
    """Terms of the documents of a shard, as numbers."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.numbers, self.lengths, self.ids, self.size = array("i"), [], [], 0

    def add(self, doc: int | None, body: bytes) -> None:
        found, known = terms_of(body), self.known
        self.size += len(body)
        if found:
            self.numbers.extend([known.setdefault(t, len(known)) for t in found])
            self.lengths.append(len(found))
            self.ids.append(doc)

    def close(self, folder: str) -> pa.RecordBatch:
        docs = len(self.ids)
        lengths = np.array(self.lengths, np.int64)
        pairs = np.frombuffer(self.numbers, np.int32).astype(np.int64) * docs + np.repeat(np.arange(docs), lengths)
        pairs, occurrences = np.unique(pairs, return_counts=True)
        counts = np.bincount(pairs // docs, minlength=len(self.known))
        head = blocks.squeeze(b"\n".join(self.known), counts.astype("<i8"))
        has_id = np.array([i is not None for i in self.ids])
        ids = np.array([i or 0 for i in self.ids], "<i8")
        rest = blocks.squeeze(ids, has_id, lengths.astype("<i8"), blocks.planes((pairs % docs).astype("<i4")), blocks.planes(occurrences.astype("<i4")))
        uri = f"{folder}/shards/{work.fresh_name('shard')}"
        work.write_file(uri, head, rest)
        return work.batch_of(_SHARD, uri=[uri], head=[len(head)], documents=[docs], terms=[int(lengths.sum())])


def index(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the shards of all documents; returns their manifest.  A document longer than a shard is one of its own."""

    def run(batches):
        writer = _Writer()
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = body.as_py() or b""
                if writer.ids and writer.size + len(body) > shard_bytes:
                    yield writer.close(folder)
                    writer = _Writer()
                writer.add(doc, body)
        if writer.ids:
            yield writer.close(folder)

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("body"))
    return work.materialize(rows.mapInArrow(run, _SHARD_DDL), f"{folder}/index")


def _query_block(ids: list[int | None], bodies: list[bytes], rest: pa.Table) -> tuple[bytes, int]:
    """A block of queries: distinct terms, and per query its terms with their repeats."""
    known: dict[bytes, int] = {}
    terms, repeats, sizes = [], [], []
    for body in bodies:
        own = np.array([known.setdefault(t, len(known)) for t in terms_of(body)], np.int64)
        term, times = np.unique(own, return_counts=True)
        terms.append(term)
        repeats.append(times)
        sizes.append(len(term))
    flat = lambda parts: np.concatenate([*parts, np.zeros(0, np.int64)]).astype("<i8")
    has_id = np.array([i is not None for i in ids], bool)
    return blocks.squeeze(b"\n".join(known), np.array([i or 0 for i in ids], "<i8"), has_id, np.array(sizes, "<i8"), flat(terms), flat(repeats)), len(known)


def _split(data: bytes) -> list[bytes]:
    return data.split(b"\n") if data else []


def _document_counts(shards: DataFrame, queries: list[str]) -> DataFrame:
    """Rows (block, term, df): in how many documents of all shards each term of a block of queries is."""
    schema = pa.schema([("block", pa.int64()), ("term", pa.int64()), ("df", pa.int64())])

    def run(batches):
        asked = [_split(blocks.expand(work.read_file(uri))[0]) for uri in queries]
        for batch in batches:
            for uri, head in zip(batch.column("uri").to_pylist(), batch.column("head").to_pylist(), strict=True):
                names, counts = blocks.expand(work.read_file(uri, 0, head))
                held = dict(zip(_split(names), np.frombuffer(counts, "<i8").tolist(), strict=True))
                for block, terms in enumerate(asked):
                    found = [(k, held[t]) for k, t in enumerate(terms) if t in held]
                    yield work.batch_of(schema, block=[block] * len(found), term=[k for k, _ in found], df=[n for _, n in found])

    rows = blocks.spread(shards).select("uri", "head").mapInArrow(run, "block bigint, term bigint, df bigint")
    return rows.groupBy("block", "term").agg(F.sum("df").alias("df"))


def _weigh(counts: DataFrame, queries: list[str], folder: str, documents: int) -> DataFrame:
    """Store the weights of each block's terms in a file; rows (block, queries, weights) of their places."""
    schema = pa.schema([("block", pa.int64()), ("queries", pa.string()), ("weights", pa.string())])

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        weights = np.zeros(len(_split(blocks.expand(work.read_file(queries[block]))[0])), "<i8")
        weights[table.column("term").to_numpy()] = [weight(documents, n) for n in table.column("df").to_pylist()]
        uri = f"{folder}/weights/{work.fresh_name('weights')}"
        work.write_file(uri, blocks.squeeze(weights))
        return pa.Table.from_batches([work.batch_of(schema, block=[block], queries=[queries[block]], weights=[uri])])

    return work.materialize(counts.groupBy("block").applyInArrow(run, "block bigint, queries string, weights string"), f"{folder}/weighed")


class _Postings:
    """One term's postings in a shard, by document and by falling impact."""

    def __init__(self, docs: np.ndarray, impacts: np.ndarray):
        self.docs, self.impacts = docs, impacts
        order = np.argsort(-impacts, kind="stable")
        self.by_impact, self.falling = docs[order], impacts[order]
        self.negative = -self.falling

    def down_to(self, level: int) -> int:
        """Postings whose impact is at least ``level``: whole groups of one impact."""
        return int(np.searchsorted(self.negative, -level, "right"))


def best(terms: list[tuple[_Postings, int]], documents: int, k: int, candidates: int = CANDIDATES) -> tuple[np.ndarray, np.ndarray]:
    """Documents (by number) among which the k best are, and their exact scores.

    ``terms`` are a query's postings with repeats.  A level takes in all groups of impacts down to it; each is half of
    the one before.
    """
    gained = np.zeros(documents, np.int64)
    read = [0] * len(terms)
    level = max((int(p.falling[0]) * times for p, times in terms), default=0)
    while True:
        left = 0
        for t, (p, times) in enumerate(terms):
            to = p.down_to(-(-level // times))
            if to > read[t]:
                gained[p.by_impact[read[t] : to]] += times * p.falling[read[t] : to]
                read[t] = to
            if to < len(p.falling):
                left += times * int(p.falling[to])
        if left == 0:
            found = np.flatnonzero(gained)
            return found, gained[found]
        if documents > k:
            last = int(np.partition(gained, documents - k)[documents - k])
            if last > left:  # a document not seen so far can't come in any more
                found = np.flatnonzero(gained + left >= last)
                if len(found) <= candidates * k:
                    break
        level = max(1, level // 2)
    scores = np.zeros(len(found), np.int64)
    for p, times in terms:
        at = np.minimum(np.searchsorted(p.docs, found), len(p.docs) - 1)
        scores += np.where(p.docs[at] == found, times * p.impacts[at], 0)
    return found, scores


def _search(shard: tuple[str, int], queries: str, weights: str, mean: tuple[int, int], k: int):
    """(place of the query, its id, document ids, scores) of the queries of a block in one shard."""
    documents, total = mean
    names, counts = blocks.expand(work.read_file(shard[0], 0, shard[1]))
    ids, has_id, lengths, docs, occurrences = blocks.expand(work.read_file(shard[0], shard[1]))
    number = {t: i for i, t in enumerate(_split(names))}
    ends = np.cumsum(np.frombuffer(counts, "<i8"))
    ids, has_id, lengths = np.frombuffer(ids, "<i8"), np.frombuffer(has_id, bool), np.frombuffer(lengths, "<i8")
    docs, occurrences = blocks.unplanes(docs, "<i4"), blocks.unplanes(occurrences, "<i4")
    damping = 12 * (100 - 25 + 25 * lengths * documents // total)
    asked, item_ids, item_has_id, sizes, terms, repeats = blocks.expand(work.read_file(queries))
    weight_of = np.frombuffer(blocks.expand(work.read_file(weights))[0], "<i8")
    postings: dict[int, _Postings] = {}
    for t, name in enumerate(_split(asked)):
        at = number.get(name)
        if at is not None and weight_of[t] > 0:
            own = slice(int(ends[at - 1]) if at else 0, int(ends[at]))
            tf = occurrences[own].astype(np.int64)
            postings[t] = _Postings(docs[own], weight_of[t] * (1_000_000_000 * tf // (1000 * tf + damping[docs[own]])))
    item_ids, item_has_id = np.frombuffer(item_ids, "<i8").tolist(), np.frombuffer(item_has_id, bool).tolist()
    terms, repeats, at = np.frombuffer(terms, "<i8").tolist(), np.frombuffer(repeats, "<i8").tolist(), 0
    for place, size in enumerate(np.frombuffer(sizes, "<i8").tolist()):
        own = [(postings[t], times) for t, times in zip(terms[at : at + size], repeats[at : at + size], strict=True) if t in postings]
        at += size
        found, scores = best(own, len(ids), k)
        top = np.lexsort((ids[found], ~has_id[found], -scores))[:k]
        top = top[scores[top] > 0]
        yield place, item_ids[place] if item_has_id[place] else None, [int(ids[d]) if has_id[d] else None for d in found[top].tolist()], scores[top].tolist()


def search(shards: DataFrame, items: DataFrame, folder: str, *, k: int = 20, item_col: str = "item_id", text_col: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The k best documents of an index for each row of items: item_id, rank, doc_id, score."""
    sums = shards.agg(F.sum("documents"), F.sum("terms")).first()
    documents, total = int(sums[0] or 0), int(sums[1] or 0)
    asked = items.select(F.col(item_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("body"))
    # One file of queries has at most query_bytes, so the list of files is short.
    files = [r[0] for r in blocks.write_blocks(asked, f"{folder}/queries", _query_block, block_bytes=query_bytes).where("weight > 0").select("uri").sort("uri").collect()]
    weighed = _weigh(_document_counts(shards, files), files, folder, documents).collect() if files else []
    known = [(r["block"], r["queries"], r["weights"]) for r in weighed]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block, queries, weights = known[row["query"]]
                for place, item, docs, scores in _search((row["uri"], row["head"]), queries, weights, (documents, total), k):
                    n = len(docs)
                    yield work.batch_of(_FOUND, block=[block] * n, place=[place] * n, item_id=[item] * n, doc_id=docs, score=scores)

    pairs = shards.select("uri", "head", F.explode(F.array(*(F.lit(i) for i in range(len(known))))).alias("query")) if known else shards.select("uri", "head", F.lit(0).alias("query")).limit(0)
    found = work.materialize(pairs.repartition(max(1, min(blocks.MOST_PARTITIONS, shards.count() * len(known)))).mapInArrow(run, _FOUND_DDL), f"{folder}/found")
    order = Window.partitionBy("block", "place").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The k best of all documents for each item."""
    folder = work.workspace(docs.sparkSession, "lexical")
    return search(index(docs, folder), items, folder, k=k)
