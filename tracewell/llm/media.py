"""ISO base media files as column values: build, walk and index without decoding samples.

``mux`` stores a payload losslessly as fixed-size 8-bit samples of a raw data
track.  ``probe`` walks the nested boxes of any ISO media file and decodes the
sample tables (stts, stsc, stsz or stz2, stco or co64, stss) of each track into
codec, duration, sample ranges and keyframe ranges; it never looks into mdat.
Media columns are written as a Parquet table and read back by Spark, and what
``probe`` finds (codec, duration, byte ranges from keyframe to keyframe) is
stored as columns beside them, so that later reads fetch only the ranges they
need.

Defined results: a null payload is an empty one, padded like any other to one
unit; bytes that are no ISO media file, or are cut off, probe to an ``error``
and no tracks; boxes of unknown type are skipped.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work

#: Bytes of a sample, samples between keyframes, samples of a chunk, and ticks a second.
UNIT = 64
KEY_EVERY = 16
CHUNK_SAMPLES = 256
TIMESCALE = 8000

# Boxes that hold boxes, by ISO/IEC 14496-12.
CONTAINERS = frozenset((b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"mvex", b"moof", b"traf", b"mfra", b"udta"))
UNITY = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full_box(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(payload: bytes, unit: int = UNIT) -> bytes:
    """Zero bytes up to a positive multiple of ``unit``."""
    return payload.ljust(max(1, -(-len(payload) // unit)) * unit, b"\0")


def mux(payload: bytes, *, unit: int = UNIT, key_every: int = KEY_EVERY) -> bytes:
    """A file of one track whose samples are the payload's units, in order.

    The payload's length must be a positive multiple of ``unit``.
    """
    samples = len(payload) // unit
    if samples * unit != len(payload) or not samples:
        raise ValueError("the payload isn't a positive multiple of the unit")
    ticks = samples * unit  # a byte lasts one tick
    chunks, rest = divmod(samples, CHUNK_SAMPLES)
    runs = [(1, CHUNK_SAMPLES)] * bool(chunks) + [(chunks + 1, rest)] * bool(rest)
    keys = np.arange(1, samples + 1, key_every, dtype=">u4")
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso6")

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks + bool(rest), dtype=np.int64) * (CHUNK_SAMPLES * unit)
        wide = bool(offsets[-1] >> 32)
        entry = box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, TIMESCALE << 16))
        stbl = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(">III", 1, samples, unit)),
            full_box(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", chunk, n, 1) for chunk, n in runs)),
            full_box(b"stsz", struct.pack(">II", unit, samples)),
            full_box(b"co64" if wide else b"stco", struct.pack(">I", len(offsets)), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        minf = box(b"minf", full_box(b"smhd", bytes(4)), box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full_box(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0), version=1), full_box(b"hdlr", bytes(4), b"soun", bytes(12), b"payload\0"), minf)
        tkhd = full_box(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, ticks), bytes(8), struct.pack(">hhhH", 0, 0, 0x100, 0), UNITY, bytes(8), version=1, flags=7)
        mvhd = full_box(b"mvhd", struct.pack(">QQIQIH", 0, 0, TIMESCALE, ticks, 0x10000, 0x100), bytes(10), UNITY, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    # Chunk offsets have a fixed width, so the header's size is known before they are.
    head = 8 if len(payload) + 8 < 1 << 32 else 16
    first = len(ftyp) + len(moov(0)) + head
    if first + len(payload) >> 32:
        first = len(ftyp) + len(moov(1 << 32)) + head
    return b"".join((ftyp, moov(first), box(b"mdat", payload)))


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()):
    """Every box as (path, start and end of its body), outer boxes first."""
    end = len(data) if end is None else end
    at = start
    while at < end:
        if end - at < 8:
            raise ValueError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if end - at < 16:
                raise ValueError("a box header is cut off")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - at
        if kind == b"uuid":
            body += 16
        if at + size > end or at + size < body:
            raise ValueError("a box exceeds its container")
        own = (*path, kind)
        yield own, body, at + size
        if kind in CONTAINERS:
            yield from walk(data, body, at + size, own)
        at += size


def _table(data: bytes, at: int, end: int, width: int, dtype: str) -> np.ndarray:
    (count,) = struct.unpack_from(">I", data, at)
    if at + 4 + count * width > end:
        raise ValueError("a sample table is cut off")
    return np.frombuffer(data, dtype, count * width // np.dtype(dtype).itemsize, at + 4).reshape(count, -1).astype(np.int64)


def _duration(data: bytes, at: int) -> tuple[int, int]:
    """Timescale and duration of mvhd or mdhd."""
    return struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)


def _track(data: bytes, boxes: dict[bytes, tuple[int, int]]) -> dict:
    at, _ = boxes[b"stsd"]
    codec = data[at + 12 : at + 16].decode("latin-1")
    timescale, duration = _duration(data, boxes[b"mdhd"][0])
    if b"stsz" in boxes:
        at, end = boxes[b"stsz"]
        uniform, count = struct.unpack_from(">II", data, at + 4)
        sizes = np.full(count, uniform, np.int64) if uniform else _table(data, at + 8, end, 4, ">u4")[:, 0]
    else:
        at, end = boxes[b"stz2"]
        bits, (count,) = data[at + 7], struct.unpack_from(">I", data, at + 8)
        raw = np.frombuffer(data, np.uint8, (count * bits + 7) // 8, at + 12)
        sizes = np.stack((raw >> 4, raw & 15), axis=1).ravel()[:count].astype(np.int64) if bits == 4 else raw.view(f">u{bits // 8}").astype(np.int64)
    wide = b"co64" in boxes
    at, end = boxes[b"co64" if wide else b"stco"]
    chunks = _table(data, at + 4, end, 8 if wide else 4, ">u8" if wide else ">u4")[:, 0] if end - at > 8 else np.zeros(0, np.int64)
    at, end = boxes[b"stsc"]
    runs = _table(data, at + 4, end, 12, ">u4")
    per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1))) if len(chunks) else np.zeros(0, np.int64)
    if per_chunk.sum() != len(sizes):
        raise ValueError("chunks and samples don't agree")
    chunk_of = np.repeat(np.arange(len(chunks)), per_chunk)
    before = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    first_of_chunk = np.concatenate(([0], np.cumsum(per_chunk)))[:-1]
    offsets = chunks[chunk_of] + before - before[first_of_chunk[chunk_of]] if len(sizes) else before
    if len(sizes) and (offsets + sizes).max() > len(data):
        raise ValueError("samples lie beyond the end")
    at, end = boxes[b"stts"]
    ticks = int(_table(data, at + 4, end, 8, ">u4").prod(axis=1).sum())
    if b"stss" in boxes:
        at, end = boxes[b"stss"]
        keys = _table(data, at + 4, end, 4, ">u4")[:, 0] - 1
    else:
        keys = np.arange(len(sizes))
    return {"codec": codec, "timescale": timescale, "duration": duration, "ticks": ticks, "offsets": offsets, "sizes": sizes, "keys": keys}


def probe(data: bytes | None) -> dict:
    """brand, timescale, duration and tracks of a file, from its boxes alone.

    A track has codec, timescale, duration, ticks, offsets and sizes of its samples and the places of keyframes.
    """
    out: dict = {"brand": None, "timescale": None, "duration": None, "tracks": [], "error": None}
    own: dict[bytes, tuple[int, int]] = {}
    found = []
    try:
        for path, at, end in walk(data or b""):
            if path == (b"ftyp",):
                out["brand"] = data[at : at + 4].decode("latin-1")
            elif path == (b"moov", b"mvhd"):
                out["timescale"], out["duration"] = _duration(data, at)
            elif path == (b"moov", b"trak"):
                found.append(own := {})
            elif path[:2] == (b"moov", b"trak"):
                own[path[-1]] = (at, end)
        if out["brand"] is None or out["duration"] is None:
            raise ValueError("no ftyp or no moov")
        out["tracks"] = [_track(data, boxes) for boxes in found]
    except (ValueError, KeyError, IndexError, struct.error) as problem:
        out |= {"tracks": [], "error": str(problem) or type(problem).__name__}
    return out


def sample_bytes(data: bytes, track: dict) -> bytes:
    """The samples' bytes in order; neighbouring ranges are read as one."""
    offsets, sizes = track["offsets"], track["sizes"]
    if not len(offsets):
        return b""
    breaks = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    firsts = np.concatenate(([0], breaks))
    lasts = np.concatenate((breaks, [len(offsets)])) - 1
    return b"".join(data[a:b] for a, b in zip(offsets[firsts].tolist(), (offsets[lasts] + sizes[lasts]).tolist(), strict=True))


def keyframe_ranges(track: dict) -> np.ndarray:
    """Rows (first byte, byte behind the last) from each keyframe to the next."""
    offsets, sizes, keys = track["offsets"], track["sizes"], track["keys"]
    if not len(keys):
        return np.zeros((0, 2), np.int64)
    lasts = np.append(keys[1:], len(sizes)) - 1
    return np.stack((offsets[keys], offsets[lasts] + sizes[lasts]), axis=1)


def feature(info: dict) -> str:
    """Of every track codec, seconds, samples, keyframes and a checksum of all keyframe ranges, as text."""
    if info["error"] or not info["tracks"]:
        return f"error={info['error'] or 'no tracks'}"
    out = [f"brand={info['brand']}"]
    for track in info["tracks"]:
        ranges = keyframe_ranges(track)
        out.append(f"codec={track['codec']};seconds={track['duration'] / track['timescale']:.6f};samples={len(track['sizes'])};keyframes={len(ranges)};ranges_crc32={zlib.crc32(ranges.astype('<i8').tobytes())}")
    return ";".join(out)


INDEXED = "codec array<string>, seconds array<double>, keyframe_ranges array<struct<track: int, keyframe: bigint, first_byte: bigint, last_byte: bigint>>"


def indexed(info: dict) -> tuple[list[str], list[float], dict[str, np.ndarray]]:
    """Codec and seconds of every track, and all their keyframe ranges (last_byte exclusive)."""
    tracks = info["tracks"]
    ranges = [keyframe_ranges(t) for t in tracks]
    both = np.concatenate(ranges) if ranges else np.zeros((0, 2), np.int64)
    keys = np.concatenate([t["keys"] for t in tracks]) if tracks else np.zeros(0, np.int64)
    columns = {"track": np.repeat(np.arange(len(tracks)), [len(r) for r in ranges]).astype(np.int32), "keyframe": keys.astype(np.int64), "first_byte": both[:, 0], "last_byte": both[:, 1]}
    return [t["codec"] for t in tracks], [t["duration"] / t["timescale"] for t in tracks], columns


def index_arrays(found: list[tuple[list[str], list[float], dict[str, np.ndarray]]]) -> list[pa.Array]:
    """The columns of ``INDEXED`` for some files."""
    fields = [("track", pa.int32()), ("keyframe", pa.int64()), ("first_byte", pa.int64()), ("last_byte", pa.int64())]
    ranges = pa.StructArray.from_arrays([pa.array(np.concatenate([f[2][n] for f in found]) if found else [], t) for n, t in fields], [n for n, _ in fields])
    ends = np.concatenate(([0], np.cumsum([len(f[2]["track"]) for f in found]))).astype(np.int32)
    return [pa.array([f[0] for f in found], pa.list_(pa.string())), pa.array([f[1] for f in found], pa.list_(pa.float64())), pa.ListArray.from_arrays(pa.array(ends), ranges)]


def media_column(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT) -> DataFrame:
    """doc_id, n_bytes (unpadded) and media: each text as an ISO media file."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def store(batches):
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(1)]
            yield work.batch_of(schema, doc_id=batch.column(0).to_pylist(), n_bytes=[len(t) for t in texts], media=[mux(pad(t, unit), unit=unit) for t in texts])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("binary")).mapInArrow(store, "doc_id bigint, n_bytes bigint, media binary")


def media_index(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per keyframe range: id, track, codec, seconds, keyframe, first_byte, last_byte (exclusive)."""

    def index(batches):
        for batch in batches:
            found = [indexed(probe(data.as_py())) for data in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *index_arrays(found)], names=["id", "codec", "seconds", "keyframe_ranges"])

    files = media.select(F.col(id_col).cast("bigint"), F.col(media_col)).mapInArrow(index, f"id bigint, {INDEXED}")
    ranges = files.select("id", "codec", "seconds", F.explode("keyframe_ranges").alias("r"))
    return ranges.select("id", "r.track", F.get("codec", F.col("r.track")).alias("codec"), F.get("seconds", F.col("r.track")).alias("seconds"), "r.keyframe", "r.first_byte", "r.last_byte")


def media_digests(media: DataFrame) -> DataFrame:
    """Digests of what a media column's files hold, read through their sample tables, and the stored index of each file."""
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    schema = pa.schema([(n, pa.string() if n in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for n in names])

    def read(batches):
        for batch in batches:
            rows: dict[str, list] = {n: [] for n in names}
            found = []
            for doc, n_bytes, media_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = media_.as_py()
                info = probe(data)
                found.append(indexed(info))
                payload = sample_bytes(data, info["tracks"][0]) if info["tracks"] else b""
                values = (doc, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(info))
                for name, value in zip(names, values, strict=True):
                    rows[name].append(value)
            yield pa.RecordBatch.from_arrays([*work.batch_of(schema, **rows).columns, *index_arrays(found)], names=[*names, "codec", "seconds", "keyframe_ranges"])

    ddl = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'bigint'}" for f in schema)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, f"{ddl}, {INDEXED}")


def media_features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text in a written table of media files, read the table back and digest it."""
    folder = work.workspace(docs.sparkSession, "media")
    return media_digests(work.materialize(media_column(docs, id_col=id_col, text_col=text_col), f"{folder}/media"))
