"""Token ids in ascending document order, one wavelet matrix per shard file.

Documents are range-partitioned by id, so shard after shard holds the corpus'
token sequence in order.  A shard file is a succinct index of its tokens: one
bit-plane per bit of the id, each stably partitioned by the plane above, with
rank counts per 512 bits.  Access, counting and finding the k-th occurrence
read the planes through rank and select; no plain copy of the tokens exists.

File layout, little-endian: 8-byte magic, header length, JSON header, then
zstd frames whose sizes the header gives: document ids, lengths, the ids in use,
and bits and rank counts of each plane.

Defined results: a null text has the end id only; rows with the same id stay
apart, ordered by text; an empty table gives no shard and an empty table.
"""

from __future__ import annotations

import io
import json
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import work
from .bpe import encoder

MAGIC = b"TWAVELT1"
#: Bits that one rank count covers, and tokens after which a shard is closed.
BLOCK = 512
SHARD_TOKENS = 1_000_000


class WaveletMatrix:
    """Sequence of integers below 2**levels as bit-planes with rank support.

    planes[k] holds bit levels-1-k of every value, in the order that stable
    partitioning by the planes before leaves; zeros[k] counts its zero bits.
    """

    def __init__(self, n: int, planes: list[np.ndarray], ranks: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.ranks, self.zeros = n, planes, ranks, zeros

    @classmethod
    def build(cls, values: np.ndarray, levels: int) -> WaveletMatrix:
        planes, ranks, zeros = [], [], []
        n = len(values)
        for level in range(levels - 1, -1, -1):
            ones = (values & values.dtype.type(1 << level)) != 0
            bits = np.zeros(-(-max(n, 1) // BLOCK) * (BLOCK // 8), np.uint8)
            packed = np.packbits(ones, bitorder="little")
            bits[: len(packed)] = packed
            ranks.append(np.concatenate(([0], np.cumsum(np.bitwise_count(bits.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)))).astype(np.uint32))
            planes.append(bits)
            low = np.compress(~ones, values)
            zeros.append(len(low))
            values = np.concatenate((low, np.compress(ones, values)))
        return cls(n, planes, ranks, zeros)

    def _rank1(self, k: int, at: int) -> int:
        """Ones among the first ``at`` bits of plane k."""
        block = at // BLOCK
        first, last = block * (BLOCK // 8), at // 8
        count = int(self.ranks[k][block]) + int(np.bitwise_count(self.planes[k][first:last]).sum())
        return count + (int(self.planes[k][last]) & ((1 << (at % 8)) - 1)).bit_count() if at % 8 else count

    def _bit(self, k: int, at: int) -> int:
        return int(self.planes[k][at // 8]) >> (at % 8) & 1

    def access(self, at: int) -> int:
        """The value at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for k in range(len(self.planes)):
            bit, ones = self._bit(k, at), self._rank1(k, at)
            value = value << 1 | bit
            at = self.zeros[k] + ones if bit else at - ones
        return value

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the occurrences of a value among places lo to hi - 1 end up below the last plane."""
        for k in range(len(self.planes)):
            one_lo, one_hi = self._rank1(k, lo), self._rank1(k, hi)
            if value >> (len(self.planes) - 1 - k) & 1:
                lo, hi = self.zeros[k] + one_lo, self.zeros[k] + one_hi
            else:
                lo, hi = lo - one_lo, hi - one_hi
        return lo, hi

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a value among places lo to hi - 1."""
        lo, hi = max(0, lo), self.n if hi is None else min(hi, self.n)
        if value < 0 or value >> len(self.planes) or lo >= hi:
            return 0
        first, last = self._range(value, lo, hi)
        return last - first

    def _select(self, k: int, bit: int, nth: int) -> int:
        """Place of the nth (from 0) such bit in plane k."""
        blocks = np.arange(len(self.ranks[k]), dtype=np.int64) * BLOCK
        before = self.ranks[k].astype(np.int64) if bit else np.minimum(blocks, self.n) - self.ranks[k]
        block = int(np.searchsorted(before, nth, side="right")) - 1
        bits = np.unpackbits(self.planes[k][block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[nth - int(before[block])])

    def select(self, value: int, nth: int) -> int:
        """Place of the nth occurrence (from 0) of a value; IndexError if there are fewer."""
        if nth < 0 or nth >= self.count(value):
            raise IndexError(nth)
        at = self._range(value, 0, self.n)[0] + nth
        for k in range(len(self.planes) - 1, -1, -1):
            bit = value >> (len(self.planes) - 1 - k) & 1
            at = self._select(k, bit, at - self.zeros[k] if bit else at)
        return at

    def values(self, dtype=np.uint16) -> np.ndarray:
        """All values: the planes' partitions undone from the last to the first."""
        out = np.zeros(self.n, dtype)
        for k in range(len(self.planes) - 1, -1, -1):
            ones = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            before, low = np.empty(self.n, dtype), self.zeros[k]
            if low:
                np.place(before, ~ones, out[:low])
            if low < self.n:
                np.place(before, ones, out[low:] | dtype(1 << (len(self.planes) - 1 - k)))
            out = before
        return out


def shard_bytes(docs: list[int | None], lengths: list[int], tokens: np.ndarray) -> bytes:
    """One shard file; ``tokens`` are the documents' ids one after the other.

    The matrix holds places in the shard's alphabet, so it has as many planes as the ids in use need.
    """
    alphabet = np.flatnonzero(np.bincount(tokens)) if len(tokens) else np.zeros(0, np.int64)
    place = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
    place[alphabet] = np.arange(len(alphabet))
    matrix = WaveletMatrix.build(place[tokens], max(1, (len(alphabet) - 1).bit_length()))
    squeeze = zstandard.ZstdCompressor(level=1).compress
    known = [0 if d is None else d for d in docs]
    parts = [np.array(known, "<i8"), np.array([d is None for d in docs], np.uint8), np.array(lengths, "<i8"), alphabet.astype("<u4"), *(x for pair in zip(matrix.planes, matrix.ranks, strict=True) for x in pair)]
    frames = [squeeze(p.tobytes()) for p in parts]
    header = json.dumps({"tokens": matrix.n, "documents": len(docs), "block": BLOCK, "zeros": matrix.zeros, "frames": [len(f) for f in frames]}).encode()
    return b"".join((MAGIC, len(header).to_bytes(4, "little"), header, *frames))


class Shard:
    """Reader of a shard file: ids by place, and counts and places of an id, from the planes."""

    def __init__(self, data: bytes):
        source = io.BytesIO(data)
        if source.read(8) != MAGIC:
            raise ValueError("not a token shard")
        head = json.loads(source.read(int.from_bytes(source.read(4), "little")))
        expand = zstandard.ZstdDecompressor().decompress
        parts = [expand(source.read(size)) for size in head["frames"]]
        none = np.frombuffer(parts[1], np.uint8)
        self.docs = [None if gone else int(d) for d, gone in zip(np.frombuffer(parts[0], "<i8"), none, strict=True)]
        self.lengths = np.frombuffer(parts[2], "<i8")
        self.alphabet = np.frombuffer(parts[3], "<u4")
        planes = [np.frombuffer(p, np.uint8) for p in parts[4::2]]
        self.matrix = WaveletMatrix(head["tokens"], planes, [np.frombuffer(p, "<u4") for p in parts[5::2]], head["zeros"])

    def _symbol(self, token: int) -> int:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else -1

    def token(self, at: int) -> int:
        return int(self.alphabet[self.matrix.access(at)])

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        return self.matrix.count(self._symbol(token), lo, hi)

    def find(self, token: int, nth: int) -> int:
        """Place of the nth occurrence (from 0) of an id; IndexError if there are fewer."""
        return self.matrix.select(self._symbol(token), nth)

    def tokens(self) -> np.ndarray:
        """All ids, 32-bit."""
        return self.alphabet[self.matrix.values(np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)]


def write_shards(docs: DataFrame, tokenizer: str, folder: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, vocabulary: int = 50_257, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write shard files under ``folder`` and return their manifest.

    Manifest: partition, shard (order within it), uri, documents, tokens, and start, the
    tokens of all shards before.
    """
    spark = docs.sparkSession
    dtype, code = (np.uint16, "H") if vocabulary <= 1 << 16 else (np.uint32, "I")
    schema = pa.schema([("partition", pa.int32()), ("shard", pa.int32()), ("uri", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())])

    def write(batches):
        encode = encoder(tokenizer, "byte", code).encode
        end = dtype(end_id).tobytes()
        partition = TaskContext.get().partitionId()
        ids, lengths, encoded, size, made = [], [], [], 0, 0

        def close():
            uri = f"{folder}/{work.fresh_name(f'tokens-{partition:06d}-{made:06d}')}.wvm"
            work.write_file(uri, shard_bytes(ids, lengths, np.frombuffer(b"".join(encoded), dtype)))
            return work.batch_of(schema, partition=[partition], shard=[made], uri=[uri], documents=[len(ids)], tokens=[size])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = encode(text.as_py()) + end
                n = len(own) // dtype().itemsize
                if ids and size + n > shard_tokens:
                    yield close()
                    ids, lengths, encoded, size, made = [], [], [], 0, made + 1
                ids.append(doc)
                lengths.append(n)
                encoded.append(own)
                size += n
        if ids:
            yield close()

    ordered = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text")
    shards = work.materialize(ordered.mapInArrow(write, "partition int, shard int, uri string, documents bigint, tokens bigint"), f"{folder}/shards")
    # The running total in two steps, so that no task sees every shard of a large corpus.
    totals = shards.groupBy("partition").agg(F.sum("tokens").alias("in_partition"))
    earlier = F.sum("in_partition").over(Window.orderBy("partition")) - F.col("in_partition")
    base = totals.select("partition", earlier.alias("base"))
    within = F.sum("tokens").over(Window.partitionBy("partition").orderBy("shard")) - F.col("tokens")
    manifest = shards.withColumn("within", within).join(base, "partition").select("partition", "shard", "uri", "documents", "tokens", (F.col("base") + F.col("within")).alias("start"))
    return work.materialize(manifest, f"{folder}/manifest").repartition(work.parallelism(spark), "uri")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Documents of all shards, from the files: doc_id, start, n_tokens, ids_crc32."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches):
        for batch in batches:
            for uri, base in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist(), strict=True):
                shard = Shard(work.read_file(uri))
                wide = shard.tokens()
                ends = np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                sums = [zlib.crc32(wide[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield work.batch_of(schema, doc_id=shard.docs, start=starts + base, n_tokens=shard.lengths, ids_crc32=sums)

    return manifest.select("uri", "start").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_shards(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the shards of a table in shared storage and read every document back."""
    return read_shards(write_shards(docs, tokenizer, work.workspace(docs.sparkSession, "tokens"), **options))
