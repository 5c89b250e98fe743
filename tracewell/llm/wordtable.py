"""BPE encoding through a table of distinct words, and decoding through an id-to-piece join.

Texts are cut into words (the vocabulary's pieces, or white-space separated
words where the pattern isn't known to be equivalent) and kept as places in
their block's word list.  The words of all blocks meet in a table of distinct
words, where each word is encoded once.  The ids of each bucket of that table
are joined with the id-to-piece table, and with the pieces found the words are
decoded.  Ids and decoded words go back to the blocks, where a text's ids and
its decoded form are put together by position.

Defined results: a null text is an empty one with no ids; repeated rows each
have a row; an empty table gives an empty table; no row's length is limited.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections import defaultdict
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import work
from .blocks import MOST_PARTITIONS, PACKED_DDL, ask, bucket_count, expand, planes, settle, squeeze, unplanes, write_blocks
from .bpe import encoder


#: Compression of what blocks and buckets send each other.
LEVEL = 3


def split_words(text: str, tokenizer) -> list[str]:
    """Parts of a text whose ids, one after the other, are the text's ids."""
    lowered = text.lower() if tokenizer.lower else text
    if tokenizer.odd(text, lowered):
        return [w for w in text.replace("\n", " ").split(" ") if w]
    return tokenizer.pieces(lowered)


def bucket_order(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words by bucket and then by word, as neighbours in order compress well, and where each bucket's places end."""
    own = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
    sorted_ = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
    order = sorted_[np.argsort(own[sorted_], kind="stable")]
    return order, np.cumsum(np.bincount(own, minlength=buckets))


def encode_word(word: str, tokenizer) -> bytes:
    """Ids of a word that :func:`split_words` gave."""
    if tokenizer.odd(word, word) or word != word.lower() or tokenizer.pieces(word) != [word]:
        return array("I", tokenizer.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
    return tokenizer.merge(word)


def _make_block(path: str):
    def make(ids: list, bodies: list[bytes], _rest: pa.Table) -> tuple[bytes, int]:
        tokenizer = encoder(path, "word")
        places = defaultdict(count().__next__)
        rows = [array("I", map(places.__getitem__, split_words(b.decode("utf-8"), tokenizer))) for b in bodies]
        flat = np.concatenate([np.frombuffer(r, np.uint32) if r else np.zeros(0, np.uint32) for r in rows])
        none = np.array([i is None for i in ids], np.uint8)
        known = np.array([0 if i is None else i for i in ids], "<i8")
        return squeeze(known, none, np.array([len(r) for r in rows], "<i8"), planes(flat), "\n".join(places).encode(), level=LEVEL), len(flat)

    return make


def _read_block(data: bytes) -> tuple[list, np.ndarray, np.ndarray, list[bytes]]:
    ids, none, lengths, flat, words = expand(data)
    docs = [None if gone else d for d, gone in zip(np.frombuffer(ids, "<i8").tolist(), none, strict=True)]
    return docs, np.frombuffer(lengths, "<i8"), unplanes(flat, "<u4") if flat else np.zeros(0, np.uint32), words.split(b"\n") if words else []


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows (id, piece) of a vocabulary; its size is the vocabulary's, whatever the corpus."""
    vocabulary = encoder(path, "word").tokenizer.get_vocab(with_added_tokens=True)
    return spark.createDataFrame(pa.table({"id": pa.array(list(vocabulary.values()), pa.int64()), "piece": pa.array(list(vocabulary), pa.string())}))


def word_table(questions: DataFrame, path: str, buckets: int) -> DataFrame:
    """A row (bucket, payload, ids) per bucket: all distinct words that blocks ask about, each encoded once, and the distinct ids among them."""

    def table(rows: pa.Table) -> pa.Table:
        tokenizer = encoder(path, "word")
        distinct = list(dict.fromkeys(chain.from_iterable(expand(p)[0].decode("utf-8").split("\n") for p in rows.column("payload").to_pylist())))
        ids = [encode_word(w, tokenizer) for w in distinct]
        payload = squeeze("\n".join(distinct).encode(), np.array([len(i) for i in ids], "<u4"), b"".join(ids))
        used = np.unique(np.frombuffer(b"".join(ids), "<u4")).astype(np.int64)
        return pa.table({"bucket": [rows.column("bucket")[0].as_py()], "payload": pa.array([payload], pa.binary()), "ids": pa.array([used], pa.list_(pa.int64()))})

    return _by_bucket(questions, buckets).applyInArrow(table, "bucket bigint, payload binary, ids array<bigint>")


def _by_bucket(rows: DataFrame, buckets: int):
    return rows.repartition(min(2 * buckets, MOST_PARTITIONS), "bucket").groupBy("bucket")


def with_pieces(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """The word table with ``found``: its ids joined with the id-to-piece table, at most the vocabulary a bucket."""
    joined = words.select("bucket", F.explode("ids").alias("id")).join(F.broadcast(pieces), "id")  # as large as the vocabulary
    found = joined.groupBy("bucket").agg(F.collect_list(F.struct("id", "piece")).alias("found"))
    return words.select("bucket", "payload").join(found, "bucket", "left")


def encoded_blocks(docs: DataFrame, path: str, folder: str, per_document, ddl: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode a table's texts; ``per_document(places, ids, decoded)`` gets each document's words' places and the block's ids and decoded texts by place, and gives a row's values behind doc_id."""
    spark = docs.sparkSession
    manifest = write_blocks(docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("binary")), folder, _make_block(path))
    buckets = bucket_count(manifest)

    def questions(data: bytes):
        words = _read_block(data)[3]
        order, ends = bucket_order(words, buckets)
        for bucket, end in enumerate(ends.tolist()):
            begin = int(ends[bucket - 1]) if bucket else 0
            if end > begin:
                yield bucket, squeeze(b"\n".join([words[i] for i in order[begin:end].tolist()]), level=LEVEL)

    def reply(table: pa.Table) -> pa.Table:
        """For each question its words' ids and, piece by piece with spaces between them, as the vocabulary has no decoder, their decoded texts."""
        uris, payloads = table.column("uri").to_pylist(), table.column("payload").to_pylist()
        own = uris.index(None)
        words, sizes, flat = expand(payloads[own])
        found = table.column("found").slice(own, 1).combine_chunks().flatten()
        pieces = dict(zip(found.field("id").to_pylist(), (p.encode() for p in found.field("piece").to_pylist()), strict=True))
        ends = np.cumsum(np.frombuffer(sizes, "<u4")).tolist()
        places = dict(zip(words.split(b"\n"), zip([0, *ends[:-1]], ends, strict=True), strict=True))
        out = []
        for uri, payload in zip(uris, payloads, strict=True):
            if uri is not None:
                ids = [flat[a:b] for a, b in map(places.__getitem__, expand(payload)[0].split(b"\n"))]
                decoded = [b" ".join([pieces[i] for i in np.frombuffer(x, "<u4").tolist()]) for x in ids]
                out.append(squeeze(planes(np.fromiter(map(len, ids), np.uint32, len(ids))), planes(np.frombuffer(b"".join(ids), "<u4")), b"\n".join(decoded), level=LEVEL))
        return pa.table({"uri": pa.array([u for u in uris if u is not None], pa.string()), "bucket": pa.array([table.column("bucket")[0].as_py()] * len(out), pa.int64()), "payload": pa.array(out, pa.binary())})

    def finish(data: bytes, told: dict[int, bytes]) -> pa.Table:
        ids, lengths, flat, words = _read_block(data)
        order, ends = bucket_order(words, buckets)
        known: list[bytes] = [b""] * len(words)
        decoded: list[bytes] = [b""] * len(words)
        for bucket, payload in told.items():
            sizes, joined, texts = expand(payload)
            stops = np.cumsum(unplanes(sizes, "<u4")).tolist()
            starts, joined = [0, *stops[:-1]], unplanes(joined, "<u4").tobytes() if joined else b""
            begin = int(ends[bucket - 1]) if bucket else 0
            for i, a, b, text in zip(order[begin : int(ends[bucket])].tolist(), starts, stops, texts.split(b"\n"), strict=True):
                known[i], decoded[i] = joined[a:b], text
        stops = np.cumsum(lengths).tolist()
        rows = []
        for n, stop in zip(lengths.tolist(), stops, strict=True):
            rows.append(per_document(flat[stop - n : stop].tolist(), known, decoded))
        return pa.table([pa.array(c, f.type) for c, f in zip([ids, *zip(*rows, strict=True)], ARROW, strict=True)], schema=ARROW)

    ARROW = pa.schema([(name, pa.string() if kind == "string" else pa.int64()) for name, kind in (c.split() for c in ddl.split(", "))])
    asked = ask(manifest, questions)
    words = work.materialize(word_table(asked, path, buckets), f"{folder}/words")
    both = asked.unionByName(with_pieces(words, piece_table(spark, path)), allowMissingColumns=True)
    answers = _by_bucket(both, buckets).applyInArrow(reply, PACKED_DDL)
    return settle(manifest, answers, finish, ddl)


def encode_decode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text."""

    def per_document(places: list[int], known: list[bytes], decoded: list[bytes]):
        ids = b"".join(map(known.__getitem__, places))
        text = b" ".join([d for d in map(decoded.__getitem__, places) if d])
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()

    return encoded_blocks(docs, path, work.workspace(docs.sparkSession, "wordtable"), per_document, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", id_col=id_col, text_col=text_col)
