"""Questions about a corpus' distinct strings, asked and answered by blocks.

Some results need, for every string of a document (word, phrase, window),
something that only the whole corpus knows: its ids, its count, whether it
occurs earlier.  A row per occurrence would multiply the data many times, so:

1. ``write_blocks`` packs documents into block files of bounded size in shared
   storage, in whatever parsed form the operator wants;
2. ``ask`` lets every block send its *distinct* strings, as one packed row per
   bucket of their hash;
3. ``answer`` groups the rows by bucket, where all blocks' copies of a string
   meet, and sends a packed answer back for each packed question;
4. ``settle`` groups the answers by block and lets the block's file be read
   again next to them.

A string that fills the corpus comes up once a block at most, so no key is
hot.  Buckets grow in number with the corpus (``bucket_count``), not in size.
A lost executor costs the re-run of its tasks: files are in shared storage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work

#: Bytes of text in a block, and of a block's text per bucket of the whole corpus.
BLOCK_BYTES = 8_000_000
BUCKET_BYTES = 16_000_000

MANIFEST = pa.schema([("uri", pa.string()), ("documents", pa.int64()), ("bytes", pa.int64()), ("weight", pa.int64())])
PACKED = pa.schema([("uri", pa.string()), ("bucket", pa.int64()), ("payload", pa.binary())])
PACKED_DDL = "uri string, bucket bigint, payload binary"


def squeeze(*arrays: np.ndarray | bytes, level: int = 1) -> bytes:
    """Arrays or byte strings as one compressed payload; :func:`expand` gives the byte strings back."""
    raw = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    head = np.array([len(raw), *map(len, raw)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=level).compress(head + b"".join(raw))


def expand(payload: bytes) -> list[bytes]:
    data = memoryview(zstandard.ZstdDecompressor().decompress(payload))
    count = int(np.frombuffer(data[:8], "<i8")[0])
    sizes = np.frombuffer(data[8 : 8 + 8 * count], "<i8").tolist()
    out, at = [], 8 + 8 * count
    for size in sizes:
        out.append(bytes(data[at : at + size]))
        at += size
    return out


def planes(values: np.ndarray) -> np.ndarray:
    """Bytes of an integer array, all lowest bytes first: such planes compress better."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T.copy()


def unplanes(data: bytes, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.frombuffer(data, np.uint8).reshape(width, -1).T.copy().view(dtype).ravel()


def write_blocks(docs: DataFrame, folder: str, make: Callable[..., tuple[bytes, int]], *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of the rows of ``docs``: an id (bigint), a body (binary) and any further columns.

    ``make(ids, bodies, rest)`` gives a file's bytes and a weight; rest is the table of the further columns.
    Returns the manifest: uri, documents, bytes of the bodies, and weight, which is the operator's to use.
    A null body is an empty one.  A block ends at ``block_bytes``; a longer document is a block of its own.
    """

    def pack(batches):
        ids, bodies, rest, size = [], [], [], 0

        def close():
            uri = f"{folder}/blocks/{work.fresh_name('block')}"
            data, weight = make(ids, bodies, pa.Table.from_batches(rest))
            work.write_file(uri, data)
            return work.batch_of(MANIFEST, uri=[uri], documents=[len(ids)], bytes=[size], weight=[weight])

        for batch in batches:
            others, begin = batch.select(batch.schema.names[2:]), 0
            for at, (doc, body) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                own = body.as_py() or b""
                if ids and size + len(own) > block_bytes:
                    rest.append(others.slice(begin, at - begin))
                    yield close()
                    ids, bodies, rest, size, begin = [], [], [], 0, at
                ids.append(doc)
                bodies.append(own)
                size += len(own)
            rest.append(others.slice(begin))
        if ids:
            yield close()

    return work.materialize(docs.mapInArrow(pack, "uri string, documents bigint, bytes bigint, weight bigint"), f"{folder}/manifest")


def table_bytes(table: pa.Table) -> bytes:
    """A table as an Arrow stream; :func:`bytes_table` reads it."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table.combine_chunks())
    return out.getvalue().to_pybytes()


def bytes_table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def bucket_count(manifest: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets for questions of about the text's size."""
    total = manifest.agg(F.sum("bytes")).first()[0] or 0
    return max(1, -(-int(total) // bucket_bytes))


def spread(manifest: DataFrame) -> DataFrame:
    """Block rows dealt evenly to tasks of a few blocks."""
    return manifest.repartition(max(1, min(manifest.count(), MOST_PARTITIONS)))


def by_block(rows: DataFrame, manifest: DataFrame):
    """Rows grouped by block, in about as many tasks as there are blocks."""
    return rows.repartition(max(1, min(manifest.count(), MOST_PARTITIONS)), "uri").groupBy("uri")


def ask(manifest: DataFrame, questions: Callable[[bytes], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Rows (uri, bucket, payload): what each block asks of each bucket."""

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                asked = list(questions(work.read_file(uri)))
                if asked:
                    yield work.batch_of(PACKED, uri=[uri] * len(asked), bucket=[b for b, _ in asked], payload=[p for _, p in asked])

    return spread(manifest).select("uri").mapInArrow(run, PACKED_DDL)


#: Partitions of a shuffle that are spread over tasks however few bytes they have.
MOST_PARTITIONS = 20_000


def answer(questions: DataFrame, buckets: int, reply: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """Rows (uri, bucket, payload): for each question of a bucket its answer, in the order given to ``reply``.

    The partitions are fixed: adaptive execution would merge them by their few bytes, not by their work.
    """

    def run(table: pa.Table) -> pa.Table:
        replies = reply(table.column("payload").to_pylist())
        return table.set_column(2, "payload", pa.array(replies, pa.binary()))

    return questions.repartition(min(2 * buckets, MOST_PARTITIONS), "bucket").groupBy("bucket").applyInArrow(run, PACKED_DDL)


def settle(manifest: DataFrame, answers: DataFrame, finish: Callable[[bytes, dict[int, bytes]], pa.Table], ddl: str) -> DataFrame:
    """Rows that ``finish(block file, {bucket: answer})`` makes of each block; blocks without answers get an empty dict."""
    all_ = manifest.select("uri", F.lit(-1).cast("bigint").alias("bucket"), F.lit(None).cast("binary").alias("payload")).unionByName(answers.select("uri", "bucket", "payload"))

    def run(table: pa.Table) -> pa.Table:
        told = {b: p for b, p in zip(table.column("bucket").to_pylist(), table.column("payload").to_pylist(), strict=True) if p is not None}
        return finish(work.read_file(table.column("uri")[0].as_py()), told)

    return by_block(all_, manifest).applyInArrow(run, ddl)
