"""WARC archives and vectors against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import pytest

from tracewell.llm import embeddings, graph, warc, work

PAGES = "page_id bigint, url string, html string, uri string, run string, sha string, first bigint, payload string"


def page_rows():
    draw = random.Random(3)
    rows = [(5, None, None), (2, "http://a.example/x", ""), (9, "not a url", "é" * 50), (4, "https://www.B.example:8443/P?q=1", "same"), (3, "http://a.example/x", "same"), (8, "http://[bad", "same"), (-7, "http://a.example/a b\r\nX: y", "r\r\n\r\nn"), (None, "http://n.example/", "null id")]
    rows += [(100 + i, f"http://h{i % 5}.example.org/{draw.randint(0, 9)}", "x" * draw.randint(0, 3000) + str(i % 7)) for i in range(60)]
    rows.append((50, "http://big.example/", "".join(draw.choice("abcdefgh ") for _ in range(300_000))))
    return rows


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "u", "r", "s", 1, "p") for r in page_rows()], PAGES).repartition(3)


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize(("archive_bytes", "least"), [(64_000_000, 0), (2_000, 0), (2_000, 100)])
def test_archives_read_back(pages, monkeypatch, archive_bytes, least):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", archive_bytes)
    out = {r.page_id: r for r in warc.archived_pages(pages, min_revisit_bytes=least).collect()}
    rows = page_rows()
    assert len(out) == len(rows)
    first = {}
    for page, _, html in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(html or "", page)
    for page, url, html in rows:
        body, r = (html or "").encode(), out[page]
        assert (r.payload_bytes, r.payload_digest) == (len(body), digest(html))
        own = page if len(body) < least or page is None else first[html or ""]
        assert (r.record_type, r.refers_to) == (("response", None) if own == page else ("revisit", own)), page
        assert (bytes(r.payload) == body) if own == page else r.payload is None
        assert (r.url is None) == (url is None)
    ranked = sorted(out.values(), key=lambda r: r.capture_rank)
    assert [r.capture_rank for r in ranked] == list(range(len(rows)))
    keys = [warc.url_key(dict((p, u) for p, u, _ in rows)[r.page_id]) for r in ranked]
    assert keys == sorted(keys)


def test_empty_pages_and_cdx(spark, pages):
    assert warc.archived_pages(spark.createDataFrame([], PAGES)).count() == 0
    folder = work.workspace(spark, "test")
    lines = [r.value for r in warc.cdx_lines(warc.merge_runs(warc.write_archives(pages, folder), folder)).collect()]
    assert len(lines) == len(page_rows()) and lines[0].split(" ")[0] <= lines[-1].split(" ")[0]


def test_repeated_page_rows_are_all_responses(spark):
    out = warc.archived_pages(spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (2, "u", "a")], "page_id bigint, url string, html string")).collect()
    assert sorted((r.page_id, r.record_type) for r in out) == [(1, "response"), (1, "response"), (2, "revisit")]


def test_loser_tree_merges_any_number_of_runs():
    draw = random.Random(1)
    for k in range(0, 12):
        runs = [sorted(draw.randint(0, 20) for _ in range(draw.randint(0, 15))) for _ in range(k)]
        assert list(warc.LoserTree(iter(r) for r in runs)) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("http://www.Example.com:80/A?b=C") == "com,example)/a?b=c"
    assert warc.url_key("https://m.example.com:8443") == "com,example,m:8443)/"
    assert warc.url_key(None) == warc.url_key("") == ""


VECTORS = "vec_id bigint, embedding array<double>, label int, unit string, place string, cells bigint, n bigint"


def vector_rows():
    draw = np.random.default_rng(6)
    base = draw.normal(size=(12, 16))
    rows = [(0, None, 1), (1, [], 1), (2, [0.0] * 16, 1), (3, [1.0, None] + [0.0] * 14, 1), (4, [float("nan")] + [1.0] * 15, 1), (5, [float("inf")] * 16, 1), (6, base[0].tolist(), None), (7, [1e200] * 16, 2), (8, [1e-200] * 16, 2), (9, [1.0, 2.0], 1), (10, [2.0, 4.0], 1), (11, [3.0], 1), (12, [5.0], 1)]
    at = 20
    for i in range(12):
        for _ in range(8):
            x = base[i] + draw.normal(size=16) * draw.choice([0, 0.02, 0.06, 0.12])
            rows.append((at, x.tolist(), int(i % 3)))
            at += 1
    rows += [(at + i, base[3].tolist(), 0) for i in range(40)]
    return rows


@pytest.mark.parametrize("block, codewords, row_cells", [(2048, 16, 62), (5, 16, 62), (5, 40, 3)])
def test_vector_links(spark, monkeypatch, block, codewords, row_cells):
    monkeypatch.setattr(embeddings, "CODEWORDS", codewords)
    monkeypatch.setattr(embeddings, "ROW_CELLS", row_cells)
    monkeypatch.setattr(embeddings.verified, "__defaults__", (block,))
    rows = vector_rows()
    df = spark.createDataFrame([(*r, "u", "p", 1, 2) for r in rows], VECTORS).repartition(3)
    out = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
    assert len(out) == len(rows)
    units = {}
    for i, v, label in rows:
        if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            x = np.array(v) / np.abs(v).max()
            units[i] = (label, x / np.linalg.norm(x))
    parent = {i: i for i, _, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = dict.fromkeys(parent, 0)
    for a, (la, x) in units.items():
        for b, (lb, y) in units.items():
            if a != b and la == lb and len(x) == len(y) and x @ y >= 0.98:
                links[a] += 1
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    for i in parent:
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (links[i], find(i), find(i) == i), i
    assert max(links.values()) > 30
    assert embeddings.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("codewords", [7, 40])
def test_bounds_hold_for_every_cell(codewords):
    draw = np.random.default_rng(2)
    centres, x = draw.normal(size=(codewords, 5)), draw.normal(size=(300, 5))
    own, low = embeddings.bounds(x, centres)
    apart = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    for i in range(300):
        assert (low[i][own] <= apart[i] + 1e-9).all()


def test_cells_come_in_ascending_order():
    draw = np.random.default_rng(3)
    a, b = draw.random((50, 6)), draw.random((50, 4)).round(1)
    met = [[] for _ in a]
    for rows, first, second in embeddings.multi_sequence(a, b, 1.1):
        for k, i, j in zip(rows, first, second, strict=True):
            met[k].append((i, j))
    for k, cells in enumerate(met):
        sums = [a[k, i] + b[k, j] for i, j in cells]
        assert sums == sorted(sums) and len(set(cells)) == len(cells)
        assert set(cells) == {(i, j) for i in range(6) for j in range(4) if a[k, i] + b[k, j] <= 1.1}
    assert [embeddings.codewords_for(n) for n in (0, 50_000, 200_000, 10**12)] == [16, 16, 32, 2500]


def test_components_of_paths_stars_and_nothing(spark):
    draw = random.Random(2)
    path = [(i, i + 1) for i in range(0, 60)]
    star = [(100, i) for i in range(101, 140)]
    edges = [*path, *star, (200, 200), (300, 301), (301, 300)]
    draw.shuffle(edges)
    out = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint"), work.workspace(spark, "test")).collect()}
    assert out == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 300: 300, 301: 300}
    assert graph.components(spark.createDataFrame([], "u bigint, v bigint"), work.workspace(spark, "test")).count() == 0
