"""Removal of repeated byte strings by prefix-free parsing.

Every string of ``LENGTH`` bytes that also starts earlier in the corpus (in a
smaller document, or further left in the same one) is removed, byte by byte.

* Parse: the rolling hashes of the ``GRAM``-byte strings inside a window of
  ``LENGTH`` bytes decide on its trigger, the smallest of them.  Windows next
  to each other with the same trigger form a phrase; neighbouring phrases
  overlap by LENGTH - 1 bytes, so each window lies in exactly one phrase and
  equal windows lie in phrases of equal trigger.
* Dictionary: phrases are asked about by trigger.  A phrase that is repeated
  as a whole is settled by its first place in the parse; a trigger that occurs
  once has nothing repeated.  What remains are different phrases with equal
  triggers, the edges of repeated passages, and phrases that repeat in themselves.
* Suffixes: for these, a suffix array of the dictionary, ordered to the depth
  of LENGTH bytes by prefix doubling, brings equal windows together; the
  phrases' places in the parse give the corpus order, and with it the first.

No step compares pairs.  A trigger with more than ``HOT_PHRASES`` different
phrases is not kept in one task: its windows are dealt out by their own hash.

The parse needs no suffix array of its own: it would order equal windows by
what follows them, but which of them comes first is a matter of (id, start).

Defined results: null and empty texts have nothing to remove; texts below
LENGTH bytes stay whole; "earlier" is a smaller id, or the same id and a
smaller start, so of rows that share an id equal strings at the same start
don't remove each other, and rows without an id share one that is smaller than
all.  The result does not depend on how documents are put into blocks, nor on
the order in which rows or payloads arrive.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work
from .blocks import answer, ask, bucket_count, by_block, bytes_table, expand, settle, squeeze, table_bytes, write_blocks
from .strings import BYTE, PrefixHash, mixed, powers

LENGTH = 100
GRAM = 40
#: Windows hashed at a time, and different phrases of a trigger that one task takes.
CHUNK = 1 << 19
HOT_PHRASES = 20_000

def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def sliding_max(x: np.ndarray, width: int) -> np.ndarray:
    return ~sliding_min(~x, width)


def phrases(data: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, ...]:
    """Phrases of documents that lie one after the other in ``data``, each ending before its stop.

    Arrays: first window, windows, trigger and hash of each phrase, and whether its trigger occurs in it
    more than once; a phrase has windows + LENGTH - 1 bytes.
    """
    found: list[list[np.ndarray]] = [[], [], [], [], []]
    span = LENGTH - GRAM + 1
    for at in range(0, max(0, len(data) - LENGTH + 1), CHUNK):
        part = data[at : at + CHUNK + LENGTH - 1]
        hashes = PrefixHash(part)
        grams = hashes.every(GRAM)
        trigger = sliding_min(grams, span)
        # Places of triggers: a window that holds the place has the place's hash as its smallest.
        around = np.concatenate((np.zeros(span - 1, np.uint64), trigger, np.zeros(span - 1, np.uint64)))
        marks = np.flatnonzero(sliding_max(around, span) == grams)
        # Windows that would run over a document's end are no windows.
        inside = np.ones(len(trigger), bool)
        for stop in stops[np.searchsorted(stops, at, "right") : np.searchsorted(stops, at + len(part))].tolist():
            inside[max(0, stop - at - LENGTH + 1) : stop - at] = False
        starts = np.ones(len(trigger), bool)
        starts[1:] = (trigger[1:] != trigger[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(starts)
        count = np.diff(np.append(first, len(trigger)))
        keep = inside[first]
        first, count = first[keep], count[keep]
        low, high = np.searchsorted(marks, first), np.searchsorted(marks, first + count + span - 1)
        phrase = np.repeat(np.arange(len(first)), high - low)
        inside_marks = marks[np.arange(len(phrase)) + np.repeat(low - (np.cumsum(high - low) - (high - low)), high - low)]
        own_marks = np.bincount(phrase[grams[inside_marks] == trigger[first][phrase]], minlength=len(first))
        for own, values in zip(found, (first + at, count, trigger[first], hashes.of(first, first + count + LENGTH - 1), own_marks > 1), strict=True):
            own.append(values)
    if not found[0]:
        return tuple(np.zeros(0, d) for d in (np.int64, np.int64, np.uint64, np.uint64, bool))
    return tuple(np.concatenate(f) for f in found)


def earliest(doc: np.ndarray | None, at: np.ndarray | None, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the row of equal keys with the smallest (doc, at), and whether that is an earlier place.

    Without doc and at, rows are given in the order of their places, all different.
    """
    order = np.lexsort(keys[::-1] if doc is None else (at, doc, *keys[::-1]))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    rep = np.empty(len(order), np.int64)
    rep[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return rep, rep != np.arange(len(rep)) if doc is None else (doc != doc[rep]) | (at != at[rep])


def equal_windows(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and classes of all windows of phrases that lie one after the other.

    The suffixes are ranked to 8, 16, 32 and 64 bytes by prefix doubling, and two 64-byte ranks that
    overlap give those to LENGTH: windows of equal rank are equal.  Suffixes never run over a phrase's end.
    """
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data)]
    rank = np.unique(np.ascontiguousarray(words).view(">u8").ravel(), return_inverse=True)[1].astype(np.uint64)

    def doubled(rank: np.ndarray, shift: int) -> np.ndarray:
        pairs = rank[: len(rank) - shift] << np.uint64(32) | rank[shift:]
        return np.unique(pairs, return_inverse=True)[1].astype(np.uint64)

    for width in (8, 16, 32):
        rank = doubled(rank, width)
    rank = doubled(rank, LENGTH - 64)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes - LENGTH + 1)
    counts = sizes - LENGTH + 1
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    places = first + within
    return places, rank[places]


class Block:
    """A block's documents in id order, and the questions its phrases give rise to."""

    def __init__(self, stored: bytes):
        ids, none, lengths, body, self._rest = expand(stored)
        self.docs = np.frombuffer(ids, "<i8")
        self.none = np.frombuffer(none, np.uint8)
        self.lengths = np.frombuffer(lengths, "<i8")
        self.data = np.frombuffer(body, np.uint8)
        self.stops = np.cumsum(self.lengths)
        self.first, self.count, self.trigger, self.hash, self.periodic = phrases(self.data, self.stops)
        #: Whether rows share an id: then the order of places isn't that of rows.
        self.shared = bool(((self.docs[1:] == self.docs[:-1]) & (self.none[1:] == self.none[:-1])).any())
        self.rep, self.copy = self.earliest(self.first, self.trigger, self.hash)
        #: Phrases at the same place of rows that share an id fare like their representative.
        self.twins = np.flatnonzero(~self.copy & (self.rep != np.arange(len(self.rep))))

    @staticmethod
    def make(ids: list, bodies: list[bytes], rest: pa.Table) -> tuple[bytes, int]:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0))
        known = np.array([0 if ids[i] is None else ids[i] for i in order], "<i8")
        return squeeze(known, np.array([ids[i] is None for i in order], np.uint8), np.array([len(bodies[i]) for i in order], "<i8"), b"".join(bodies[i] for i in order), table_bytes(rest.take(order))), 0

    def rest(self) -> pa.Table:
        """The documents' further columns."""
        return bytes_table(self._rest)

    def parse_order(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document and start in it of places in the block; a null id comes first."""
        row = np.searchsorted(self.stops, places, "right")
        own = np.where(self.none[row] != 0, np.iinfo(np.int64).min, self.docs[row])
        return own, places - (self.stops - self.lengths)[row]

    def earliest(self, places: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """:func:`earliest` of the block's phrases or windows, which begin at ``places``."""
        return earliest(*(self.parse_order(places) if self.shared else (None, None)), *keys)

    def by_trigger(self, buckets: int):
        """The block's different phrases, by bucket of their trigger: (bucket, their places in the phrase arrays)."""
        own = np.flatnonzero(self.rep == np.arange(len(self.rep)))
        bucket = (self.trigger[own] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(own) else []:
            yield int(bucket[part[0]]), own[part]


# Answers about a phrase.
UNIQUE, COPY, EDGE, HOT_EDGE = 0, 1, 2, 3


def judge_phrases(payloads: list[bytes]) -> list[bytes]:
    """For each asked phrase: nothing repeated, a copy of an earlier one, or to be looked into."""
    parts = [expand(p) for p in payloads]
    kinds = ("<u4", "<u8", "<i8", "<i4", "?")
    trigger, hash_, doc, at, periodic = (np.concatenate([np.frombuffer(p[i], kind) for p in parts]) for i, kind in enumerate(kinds))
    rep, later = earliest(doc, at, trigger, hash_)
    first = np.flatnonzero(rep == np.arange(len(rep)))
    _, place, counts = np.unique(trigger[first], return_inverse=True, return_counts=True)
    verdict = np.full(len(rep), COPY, np.uint8)
    several = counts[place]
    verdict[first] = np.where(several > HOT_PHRASES, HOT_EDGE, np.where((several > 1) | periodic[first], EDGE, UNIQUE))
    verdict[~later] = verdict[rep[~later]]
    ends = np.cumsum([len(p[0]) // 4 for p in parts])
    return [squeeze(v) for v in np.split(verdict, ends[:-1])]


def judge_windows(payloads: list[bytes]) -> list[bytes]:
    """For each asked window, whether it starts earlier elsewhere."""
    parts = [expand(p) for p in payloads]
    sizes, doc, at = (np.concatenate([np.frombuffer(p[i], kind) for p in parts]) for i, kind in enumerate(("<i4", "<i8", "<i4")))
    sizes = sizes.astype(np.int64)
    places, class_ = equal_windows(np.frombuffer(b"".join(p[3] for p in parts), np.uint8), sizes)
    counts = sizes - LENGTH + 1
    of = np.repeat(np.arange(len(sizes)), counts)
    start = at[of] + (places - (np.cumsum(sizes) - sizes)[of])
    _, out = earliest(doc[of], start, class_)
    ends = np.cumsum([int((np.frombuffer(p[0], "<i4").astype(np.int64) - LENGTH + 1).sum()) for p in parts])
    return [squeeze(np.packbits(v)) for v in np.split(out, ends[:-1])]


def window_hashes(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Hashes of the windows at some places."""
    out = [np.zeros(0, np.uint64)]
    for at in range(0, len(places), 1 << 15):
        rows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[places[at : at + (1 << 15)]]
        out.append(mixed((BYTE[rows] * powers(LENGTH)[0][:LENGTH]).sum(axis=1, dtype=np.uint64)))
    return np.concatenate(out)


def windows_of(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Every window of phrases, phrase after phrase."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


class Edges:
    """What a block asks about windows: its edge phrases, and the different windows of hot triggers one by one."""

    def __init__(self, block: Block, verdict: np.ndarray, buckets: int):
        asks = block.rep == np.arange(len(block.rep))
        own, hot = np.flatnonzero(asks & (verdict == EDGE)), np.flatnonzero(asks & (verdict == HOT_EDGE))
        windows = windows_of(block.first[hot], block.count[hot])
        hashes = window_hashes(block.data, windows) if len(hot) else np.zeros(0, np.uint64)
        rep, again = block.earliest(windows, hashes)
        #: Hot windows that the block itself has earlier, and those that fare like another one.
        self.again = windows[again]
        first_of = rep == np.arange(len(rep))
        self.alike = windows[~again & ~first_of], windows[rep[~again & ~first_of]]
        first = np.concatenate((block.first[own], windows[first_of]))
        count = np.concatenate((block.count[own], np.ones(np.count_nonzero(first_of), np.int64)))
        bucket = (np.concatenate((block.trigger[own], hashes[first_of])) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        self.parts = [(int(bucket[x[0]]), first[x], count[x]) for x in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(x)]


def duplicate_spans(docs: DataFrame, per_block, ddl, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows that ``per_block(block, removed)`` makes, where removed marks the bytes of the block to remove.

    ``carry`` names further columns that come along in ``block.rest()``.
    """
    folder = work.workspace(docs.sparkSession, "suffixes")
    manifest = write_blocks(docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("binary"), *(F.col(c).alias(f"carried{k}") for k, c in enumerate(carry))), folder, Block.make)
    buckets = bucket_count(manifest)

    def ask_phrases(data: bytes):
        block = Block(data)
        for bucket, own in block.by_trigger(buckets):
            doc, at = block.parse_order(block.first[own])
            yield bucket, squeeze((block.trigger[own] >> np.uint64(20)).astype("<u4"), block.hash[own], doc, at.astype("<i4"), block.periodic[own])

    verdicts = work.materialize(answer(ask(manifest, ask_phrases), buckets, judge_phrases), f"{folder}/verdicts")

    def verdict_of(block: Block, told: dict[int, bytes]) -> np.ndarray:
        verdict = np.full(len(block.first), COPY, np.uint8)
        for bucket, own in block.by_trigger(buckets):
            verdict[own] = np.frombuffer(expand(told[bucket])[0], np.uint8)
        verdict[block.twins] = verdict[block.rep[block.twins]]
        return verdict

    packed = pa.schema([("uri", pa.string()), ("bucket", pa.int64()), ("payload", pa.binary())])

    def ask_windows_of(uri: str, told: dict[int, bytes]) -> pa.Table:
        block = Block(work.read_file(uri))
        asked = []
        for bucket, first, count in Edges(block, verdict_of(block, told), buckets).parts:
            doc, at = block.parse_order(first)
            text = b"".join(block.data[a:b].tobytes() for a, b in zip(first.tolist(), (first + count + LENGTH - 1).tolist(), strict=True))
            asked.append((bucket, squeeze((count + LENGTH - 1).astype("<i4"), doc, at.astype("<i4"), text)))
        return pa.table([pa.array([uri] * len(asked), pa.string()), pa.array([b for b, _ in asked], pa.int64()), pa.array([p for _, p in asked], pa.binary())], schema=packed)

    def ask_windows(table: pa.Table) -> pa.Table:
        return ask_windows_of(table.column("uri")[0].as_py(), dict(zip(table.column("bucket").to_pylist(), table.column("payload").to_pylist(), strict=True)))

    edges = by_block(verdicts, manifest).applyInArrow(ask_windows, "uri string, bucket bigint, payload binary")
    windows = answer(edges, buckets, judge_windows)
    # One group of a block has both kinds of answers: those about windows under negative buckets below -1.
    both = verdicts.unionByName(windows.withColumn("bucket", -2 - F.col("bucket")))

    def finish(data: bytes, told: dict[int, bytes]) -> pa.Table:
        block = Block(data)
        verdict = verdict_of(block, told)
        edges_ = Edges(block, verdict, buckets)
        gone = [windows_of(block.first[verdict == COPY], block.count[verdict == COPY]), edges_.again]
        for bucket, first, count in edges_.parts:
            repeats = np.unpackbits(np.frombuffer(expand(told[-2 - bucket])[0], np.uint8), count=int(count.sum())).view(bool)
            gone.append(windows_of(first, count)[repeats])
        windows = np.zeros(len(block.data) + 1, bool)
        windows[np.concatenate(gone)] = True
        windows[edges_.alike[0]] = windows[edges_.alike[1]]
        for twin in block.twins.tolist():
            a, b, n = block.first[twin], block.first[block.rep[twin]], block.count[twin]
            windows[a : a + n] = windows[b : b + n]
        rises = np.diff(windows.astype(np.int8), prepend=0)
        # A run of windows covers its own places and LENGTH - 1 bytes more.
        mark = np.bincount(np.flatnonzero(rises == 1), minlength=len(windows)) - np.bincount(np.flatnonzero(rises == -1) + LENGTH - 1, minlength=len(windows))
        return per_block(block, np.cumsum(mark)[: len(block.data)] > 0)

    return settle(manifest, both, finish, ddl)


def removal_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def digest(block: Block, removed: np.ndarray) -> pa.Table:
        rows: list[list] = [[] for _ in schema]
        for doc, none, stop, n in zip(block.docs.tolist(), block.none.tolist(), block.stops.tolist(), block.lengths.tolist(), strict=True):
            gone, body = removed[stop - n : stop], block.data[stop - n : stop]
            spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])) if n else 0
            for own, value in zip(rows, (None if none else doc, n, int(np.count_nonzero(gone)), spans, hashlib.sha256(body[~gone] if spans else body).hexdigest()), strict=True):
                own.append(value)
        return pa.table([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return duplicate_spans(docs, digest, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", id_col=id_col, text_col=text_col)


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each text without its repeated strings.

    A character of which only some bytes were removed is dropped whole; null texts become empty.
    """
    schema = docs.schema

    def cut(block: Block, removed: np.ndarray) -> pa.Table:
        texts = [block.data[stop - n : stop][~removed[stop - n : stop]].tobytes().decode("utf-8", "ignore") for stop, n in zip(block.stops.tolist(), block.lengths.tolist(), strict=True)]
        rest = block.rest()
        at = names.index(text_col)
        return rest.set_column(at, "text", pa.array(texts, pa.string())).rename_columns(names)

    # The text's place among the carried columns is held by a null.
    names = docs.columns
    place = work.unused(docs, "place")
    held = docs.withColumn(place, F.lit(None).cast("boolean"))
    carry = tuple(place if n == text_col else n for n in names)
    return duplicate_spans(held, cut, schema, id_col=id_col, text_col=text_col, carry=carry)
