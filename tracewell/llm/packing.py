"""Best-fit packing of token sequences with swap-based local search.

``token_pieces`` cuts every document's ids into pieces of at most ``capacity``;
``pack`` puts the pieces into sequences.  Pieces are dealt by a hash into
shards of about ``SHARD_PIECES``; each shard is packed on its own, so the cost
of sharding is less than one partly filled sequence a shard.  In a shard,
best-fit decreasing gives a start; then documents of the emptiest underfull
sequences are moved or exchanged (one for one, two for one, one for two) into
fuller ones.  Every step raises the sum of squared fill, so the search ends;
sequences that run empty disappear.

Defined results: a null text is an empty one (only the end id); a piece of
exactly ``capacity`` is a sequence of its own; repeated rows are packed as
separate documents; an empty table gives an empty table; a null id is kept.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import work
from .bpe import encoder

CAPACITY = 2048
SHARD_PIECES = 16384
#: Emptiest sequences that offer their documents to an underfull one in a round of the search.
NEIGHBOURS = 16
#: Rounds without an emptied sequence after which the search ends.
PATIENCE = 3


def token_pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", kind: str = "word", end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its ids followed by ``end_id``; only longer ones than ``capacity`` are cut.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids)
    end = end_id.to_bytes(4, "little")

    def cut(batches):
        encode = encoder(tokenizer, kind).encode
        step = 4 * capacity
        for batch in batches:
            rows: dict[str, list] = {f.name: [] for f in schema}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows["doc_id"].append(doc)
                    rows["piece"].append(k)
                    rows["start"].append(at // 4)
                    rows["length"].append(len(part) // 4)
                    rows["ids_crc32"].append(zlib.crc32(part))
                    if with_ids:
                        rows["ids"].append(np.frombuffer(part, "<u4").astype(np.int32))
            yield work.batch_of(schema, **rows)

    fields = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(cut, fields)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of item positions."""
    bins: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if some bin has r left
    for item in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        size = lengths[item]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
            bins[at].append(item)
        else:
            room, at = capacity, len(bins)
            bins.append([item])
        left = room - size
        if left:
            with_room[left].append(at)
            rooms |= 1 << left
    return bins


class _Bin:
    """A sequence in the search: items by ascending length."""

    __slots__ = ("fill", "items", "known")

    def __init__(self, items: list[tuple[int, int]]):
        self.items = sorted(items)
        self.fill = sum(x[0] for x in items)
        self.known: tuple[int, int] | None = None

    def lengths(self) -> tuple[int, int]:
        """Lengths of single items and of two together, as bits."""
        if self.known is None:
            one = two = 0
            for size, _ in self.items:
                two |= one << size
                one |= 1 << size
            self.known = one, two
        return self.known

    def swap(self, out: list[tuple[int, int]], into: list[tuple[int, int]]) -> None:
        for x in out:
            self.items.remove(x)
        for x in into:
            insort(self.items, x)
        self.known = None
        self.fill += sum(x[0] for x in into) - sum(x[0] for x in out)


def _largest(items: list[tuple[int, int]], low: int, high: int) -> tuple[int, int] | None:
    """The longest item with low <= length <= high."""
    at = bisect_right(items, (high, 1 << 62)) - 1
    return items[at] if at >= 0 and items[at][0] >= low else None


def _smallest(items: list[tuple[int, int]], low: int) -> tuple[int, int] | None:
    at = bisect_left(items, (low, -1))
    return items[at] if at < len(items) else None


def _improve(giver: _Bin, taker: _Bin, capacity: int) -> bool:
    """One exchange that makes ``taker``, the fuller of the two, as full as it can get; False if none raises its fill."""
    room = capacity - taker.fill
    best, gain = None, 0
    if (x := _largest(giver.items, 1, room)) is not None:
        best, gain = ([x], []), x[0]
    for back in taker.items:  # one or two for one
        if gain == room:
            break
        if (x := _largest(giver.items, back[0] + gain + 1, back[0] + room)) is not None:
            best, gain = ([x], [back]), x[0] - back[0]
        lo, hi = 0, len(giver.items) - 1
        while lo < hi and gain < room:
            both = giver.items[lo][0] + giver.items[hi][0] - back[0]
            if both > room:
                hi -= 1
            else:
                if both > gain:
                    best, gain = ([giver.items[lo], giver.items[hi]], [back]), both
                lo += 1
    if gain < room:  # one for two
        for i, a in enumerate(taker.items):
            for b in taker.items[i + 1 :]:
                low = a[0] + b[0]
                if (x := _largest(giver.items, low + gain + 1, low + room)) is not None:
                    best, gain = ([x], [a, b]), x[0] - low
    if best is None:
        return False
    given, back = best
    giver.swap(given, back)
    taker.swap(back, given)
    return True


def _wanted(taker: _Bin, capacity: int) -> tuple[int, int]:
    """Lengths of an item, and of two together, that raise the taker's fill in some exchange of :func:`_improve`, as bits."""

    def above(bits: int) -> int:  # every bit moved by 1 to room places
        out, width = bits << 1, 1
        while width < room:
            step = min(width, room - width)
            out |= out << step
            width += step
        return out

    room = capacity - taker.fill
    one, two = taker.lengths()
    return above(1 | one | two), above(one)


def local_search(bins: list[list[int]], lengths: list[int], capacity: int, neighbours: int = NEIGHBOURS, patience: float = PATIENCE) -> list[list[int]]:
    """Empty underfull bins into fuller ones.

    From the fullest on, each underfull bin is offered exchanges with the emptiest ones, and with all others
    in a round after one that moved nothing or after ``patience`` rounds that emptied none.  The search ends
    when the bins are as few as their sum allows, when no exchange raises the squared fill any more, or
    when ``patience`` rounds and one with all others emptied none.
    """
    done = [b for b in bins if sum(lengths[i] for i in b) == capacity]
    under = [_Bin([(lengths[i], i) for i in b]) for b in bins if sum(lengths[i] for i in b) < capacity]
    idle, wide = 0, False
    while len(under) > -(-sum(b.fill for b in under) // capacity):
        moved = False
        under.sort(key=lambda b: b.fill)
        for at in range(len(under) - 1, 0, -1):
            taker, offers = under[at], 0
            wanted = _wanted(taker, capacity) if wide else None
            for giver in under[:at]:
                if taker.fill == capacity or offers == neighbours and not wide:
                    break
                if not giver.items or giver.fill > taker.fill:
                    continue
                offers += 1
                if wide:
                    one, two = giver.lengths()
                    if not (one & wanted[0] or two & wanted[1]):
                        continue
                while giver.items and taker.fill < capacity and giver.fill <= taker.fill and _improve(giver, taker, capacity):
                    moved = True
                if wide:
                    wanted = _wanted(taker, capacity)
        left = [b for b in under if b.items]
        idle = 0 if len(left) < len(under) else idle + 1
        done += [[i for _, i in b.items] for b in left if b.fill == capacity]
        under = [b for b in left if b.fill < capacity]
        if wide and (not moved or idle > patience):
            break
        wide = not moved or idle >= patience
    return done + [[i for _, i in b.items] for b in under]


def pack_lengths(lengths: list[int], capacity: int = CAPACITY, patience: float = PATIENCE) -> list[list[int]]:
    """Bins of item positions for positive lengths of at most ``capacity``."""
    return local_search(best_fit(lengths, capacity), lengths, capacity, patience=patience)


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, patience: float = PATIENCE) -> DataFrame:
    """Add sequence_id and offset to a table of pieces with the columns doc_id, piece and length.

    The table is counted and read twice, so pass a written one.  With an infinite ``patience`` the search
    only ends when no exchange raises the squared fill, however many rounds empty no sequence.

    Defined results: where columns of these names exist, underscores are added to the new ones' names; ids and
    pieces may be null and rows may repeat, as each row is packed by itself; lengths are from 1 to ``capacity``, any
    other is an error; an empty table gives an empty one.
    """
    name, place = work.unused(pieces, "sequence_id"), work.unused(pieces, "offset")
    shards = max(1, -(-pieces.count() // shard_pieces))
    keys = pieces.schema.fieldNames()

    def assign(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_pylist()
        if any(n is None or not 0 < n <= capacity for n in lengths):
            raise ValueError(f"lengths are from 1 to {capacity}")
        shard = table.column(own)[0].as_py()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for number, items in enumerate(pack_lengths(lengths, capacity, patience)):
            at = 0
            for i in sorted(items):
                sequence[i], offset[i] = (shard << 32) + number, at
                at += lengths[i]
        return table.drop_columns([own]).append_column(name, pa.array(sequence)).append_column(place, pa.array(offset))

    # The row's place in the written table is hashed too, so that repeated rows are dealt out.
    own = work.unused(pieces, "shard")
    shard = F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(shards)).cast("long")
    schema = StructType([*pieces.schema.fields]).add(name, "long").add(place, "long")
    return pieces.withColumn(own, shard).groupBy(own).applyInArrow(assign, schema).select(*keys, name, place)


def packed_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, patience: float = PATIENCE, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack whole documents: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset."""
    folder = work.workspace(docs.sparkSession, "packing")
    pieces = token_pieces(docs, tokenizer, id_col=id_col, text_col=text_col, capacity=capacity, with_ids=with_ids)
    return pack(work.materialize(pieces, f"{folder}/pieces"), capacity=capacity, patience=patience)
