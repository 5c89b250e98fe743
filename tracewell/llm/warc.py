"""WARC archives with revisit records, and a globally ordered capture index.

Pages are written as WARC 1.1 records, one gzip member each.  Every archive
file comes with a run of index entries sorted by URL key and timestamp.  The
runs are range-partitioned by (URL key, timestamp, page, run, offset), which
keeps the order of each run's entries, and each range is put in order by a k-way
merge of its sorted segments on a loser tree, without sorting them again, so the
partitions one after the other are the captures' global history.  Records are
read back through that index.

Defined results: a null page is an empty payload; a null URL has the empty key
and sorts first; of equal payloads of at least ``min_revisit_bytes`` the
smallest page id is the response (all rows that share that id are), the others
are revisits of it; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import work

#: Bytes after which an archive file is closed; each has one run of the index.
ARCHIVE_BYTES = 64_000_000
#: Index entries that one merge task takes, about.
RANGE_ENTRIES = 200_000
#: Start of the default capture times; a page is captured its id in seconds later, modulo ten years.
EPOCH = datetime(2020, 1, 1, tzinfo=UTC)
SPAN_SECONDS = 315_360_000

INDEX = pa.schema([("url_key", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("run", pa.string()), ("uri", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string())])
INDEX_DDL = "url_key string, timestamp string, page_id bigint, run string, uri string, offset bigint, length bigint, record_type string, payload_digest string"


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels reversed, then port, path and query, lower-cased, without scheme and www."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname, parts.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    labels = host.lower().split(".")
    if len(labels) > 2 and labels[0] == "www":
        labels = labels[1:]
    suffix = f":{port}" if port and port != {"http": 80, "https": 443}.get(parts.scheme) else ""
    return f"{','.join(reversed(labels))}{suffix}){parts.path.lower() or '/'}" + (f"?{parts.query.lower()}" if parts.query else "")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:x-page:{'' if page is None else page}>"


def page_of(identifier: str | None) -> int | None:
    number = (identifier or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def make_record(page: int | None, url: str | None, when: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One uncompressed record; a revisit has the HTTP header but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {when}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='''!#$%&'()*+,/:;=?@[]~''')}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (names in lower case) and payload of a record; ValueError if it is malformed."""

    def headers(block: bytes) -> dict[str, str]:
        pairs = (line.split(":", 1) for line in block.decode("utf-8").split("\r\n")[1:] if ":" in line)
        return {name.strip().lower(): value.strip() for name, value in pairs}

    head, found, rest = record.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    warc = headers(head)
    body = rest[: int(warc["content-length"])]
    if rest[len(body) :] != b"\r\n\r\n" or len(body) != int(warc["content-length"]):
        raise ValueError("the record's length is wrong")
    http, _, payload = body.partition(b"\r\n\r\n")
    return warc, headers(http), payload


def gzip_member(data: bytes, level: int = 3) -> bytes:
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


class LoserTree:
    """Merge of sorted iterators: the winner leaves, and one path of matches decides the next."""

    def __init__(self, runs: Iterable[Iterator]):
        self.runs = list(runs)
        self.k = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._sift(i)

    def _beats(self, a: int, b: int) -> bool:
        """-1, before the tree is full, beats all; a run at its end loses to all; equal heads keep the order of runs."""
        if a < 0 or b < 0:
            return a < 0
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.heads[a], a) < (self.heads[b], b)

    def _sift(self, i: int) -> None:
        winner, node = i, (i + self.k) // 2
        while node > 0:
            if self._beats(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.k and (top := self.heads[winner := self.losers[0]]) is not None:
            yield top
            self.heads[winner] = next(self.runs[winner], None)
            self._sift(winner)


def with_revisits(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, at (epoch seconds), payload and first: the smallest id with an equal payload.

    The smallest ids are aggregated before the join, and the join's sides are split by
    adaptive execution where one payload is very common.
    """
    at = F.col(time_col).cast("timestamp").cast("long") if time_col else F.lit(int(EPOCH.timestamp())) + F.pmod(F.coalesce(F.col(id_col), F.lit(0)), F.lit(SPAN_SECONDS))
    base = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), at.alias("at"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    base = base.withColumn("sha", F.when(F.length("payload") >= min_revisit_bytes, F.sha1("payload")).otherwise(F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    firsts = base.groupBy("sha").agg(F.min("page_id").alias("first"))
    return base.join(firsts, "sha").drop("sha")


def write_archives(pages: DataFrame, folder: str, **options) -> DataFrame:
    """Write archive files under ``folder``; the index entries, each run sorted, as a written table."""

    def write(batches):
        partition = TaskContext.get().partitionId()
        records, entries, size, made = [], [], 0, 0

        def close():
            run = f"{partition:06d}-{made:06d}"
            uri = f"{folder}/{work.fresh_name(f'pages-{run}')}.warc.gz"
            work.write_file(uri, *records)
            entries.sort(key=lambda e: (e[0], e[1], e[2] is not None, e[2] or 0))
            columns = list(zip(*entries, strict=True))
            return work.batch_of(INDEX, url_key=columns[0], timestamp=columns[1], page_id=columns[2], run=[run] * len(entries), uri=[uri] * len(entries), offset=columns[3], length=columns[4], record_type=columns[5], payload_digest=columns[6])

        for batch in batches:
            for page, url, at, payload, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                when = datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=at)
                digest, revisit = base32_sha1(payload), page != first
                member = gzip_member(make_record(page, url, when.strftime("%Y-%m-%dT%H:%M:%SZ"), payload, digest, first if revisit else None, revisit))
                if records and size + len(member) > ARCHIVE_BYTES:
                    yield close()
                    records, entries, size, made = [], [], 0, made + 1
                entries.append((url_key(url), when.strftime("%Y%m%d%H%M%S"), page, size, len(member), "revisit" if revisit else "response", digest))
                records.append(member)
                size += len(member)
        if records:
            yield close()

    rows = with_revisits(pages, **options).select("page_id", "url", "at", "payload", "first")
    return work.materialize(rows.mapInArrow(write, INDEX_DDL), f"{folder}/runs")


def merge_runs(runs: DataFrame, folder: str) -> DataFrame:
    """The global index: entries with capture_rank (from 0) in the order of URL key, timestamp and page.

    Each range task merges the segments that runs have in its range on a loser tree.  The shuffle keeps the
    order in which a map task sends a run's entries; a segment ends where the next entry is smaller.
    """
    spark = runs.sparkSession
    out = pa.schema([("partition", pa.int32()), ("place", pa.int64()), *INDEX])

    def merge(batches):
        segments: list[list] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                entry = ((row[0], row[1], row[2] is not None, row[2] or 0, row[3], row[5]), row)
                if not segments or entry[0] < segments[-1][-1][0]:
                    segments.append([])
                segments[-1].append(entry)
        partition, place, rows = TaskContext.get().partitionId(), 0, []

        def flush():
            columns = dict(zip(INDEX.names, zip(*rows, strict=True), strict=True))
            return work.batch_of(out, partition=[partition] * len(rows), place=range(place - len(rows), place), **columns)

        for _, row in LoserTree(iter(s) for s in segments):
            rows.append(row)
            place += 1
            if len(rows) == 10_000:
                yield flush()
                rows = []
        if rows:
            yield flush()

    # As many ranges as keep a range's entries in a task's memory; run and offset split a page that is captured very often.
    ranges = max(work.parallelism(spark), -(-runs.count() // RANGE_ENTRIES))
    dealt = runs.repartitionByRange(ranges, "url_key", "timestamp", "page_id", "run", "offset")
    merged = work.materialize(dealt.mapInArrow(merge, f"partition int, place bigint, {INDEX_DDL}"), f"{folder}/merged")
    sizes = merged.groupBy("partition").agg(F.count("*").alias("n"))
    base = sizes.select("partition", (F.sum("n").over(Window.orderBy("partition")) - F.col("n")).alias("base"))
    return merged.join(base, "partition").withColumn("capture_rank", F.col("base") + F.col("place")).drop("partition", "place", "base")


def cdx_lines(index: DataFrame) -> DataFrame:
    """The index as CDX text lines in capture order, for ``write.text``."""
    name = F.element_at(F.split("uri", "/"), -1)
    line = F.concat_ws(" ", "url_key", "timestamp", F.col("page_id").cast("string"), "record_type", "payload_digest", F.col("length").cast("string"), F.col("offset").cast("string"), name)
    return index.orderBy("capture_rank").select(line.alias("value"))


def read_archives(index: DataFrame) -> DataFrame:
    """Records of all captures, read from the archives at the index's offsets.

    page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to and capture_rank;
    the digest of a response is computed from what was read.
    """
    names = ("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "capture_rank")
    kinds = {"url": pa.string(), "payload": pa.binary(), "payload_digest": pa.string(), "record_type": pa.string()}
    schema = pa.schema([(n, kinds.get(n, pa.int64())) for n in names])

    def read(batches):
        source, opened = None, None
        for batch in batches:
            rows: dict[str, list] = {n: [] for n in names}
            size = 0
            for uri, offset, length, rank in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if uri != opened:
                    source, opened = work.open_file(uri), uri
                warc, http, payload = parse_record(zlib.decompress(source.read_at(length, offset), 31))
                revisit = warc["warc-type"] == "revisit"
                digest = warc["warc-payload-digest"].removeprefix("sha1:") if revisit else base32_sha1(payload)
                values = (page_of(warc["warc-record-id"]), warc.get("warc-target-uri"), None if revisit else payload, int(http["content-length"]) if revisit else len(payload), digest, warc["warc-type"], page_of(warc.get("warc-refers-to")), rank)
                for name, value in zip(names, values, strict=True):
                    rows[name].append(value)
                if (size := size + len(payload)) > 16_000_000:
                    yield work.batch_of(schema, **rows)
                    rows, size = {n: [] for n in names}, 0
            yield work.batch_of(schema, **rows)

    ddl = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, capture_rank bigint"
    # By archive and offset: each file is read by one task from front to back.
    ordered = index.select("uri", "offset", "length", "capture_rank").repartition(work.parallelism(index.sparkSession), "uri").sortWithinPartitions("uri", "offset")
    return ordered.mapInArrow(read, ddl)


def archived_pages(pages: DataFrame, **options) -> DataFrame:
    """Write archives and index, and read every page back through them."""
    folder = work.workspace(pages.sparkSession, "warc")
    return read_archives(merge_runs(write_archives(pages, folder, **options), folder))
