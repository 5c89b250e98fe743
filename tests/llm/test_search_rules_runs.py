"""Operators 11 to 13: ranked search, quality rules and periodic runs, against brute force and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracewell.llm import lexical, periodic, queries, rules, work

DATA = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\f\r "), (4, "..!?"), (5, "Ünïcode ÉTÉ été 漢字 abc_DEF"), (5, "same id"), (None, "no id at all, no id"), (6, "the cat " * 40),
    (7, "the cat " * 40), (8, "x" * 100_000), (9, " ".join(f"w{i % 7}" for i in range(3000))), (10, "a\na\na\n \n\nb\na"), (11, "nbsp here and there"), (12, "# $ % & | < > *"),
]


def frame(spark, rows, extra=True):
    more = ", rank int, score double, kept boolean, runs string" if extra else ""
    return spark.createDataFrame([(d, t, *([1, 0.5, True, "r"] if extra else [])) for d, t in rows], f"doc_id bigint, text string{more}")


# Search ------------------------------------------------------------------------------------------------------------


def brute_search(docs, items, k=20):
    counts = [(d, Counter(TERM.findall((t or "").translate(UPPER)))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        asked, scored = TERM.findall((text or "").translate(UPPER)), []
        for doc, c in counts:
            m = 75 + 25 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in asked if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if no else doc, -s) for r, (s, no, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


ITEMS = [(1, "the cat"), (1, "été ünïcode"), (2, None), (3, "..."), (None, "no id"), (4, "w1 w1 w2 the"), (5, "absent")]


def test_search_odd_rows(spark):
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id bigint, text string, rank int")
    for k in (1, 3, 20):
        assert found(lexical.ranked_documents(frame(spark, ODD), items, k)) == brute_search(ODD, ITEMS, k)


def test_search_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert lexical.ranked_documents(frame(spark, []), items).count() == 0
    assert lexical.ranked_documents(frame(spark, ODD), items.limit(0)).count() == 0
    assert lexical.ranked_documents(frame(spark, [(1, None)]), items).count() == 0


def test_search_many_shards_and_blocks(spark):
    """Small shards and query blocks, ties across shards, and an early stop that must not change anything."""
    rnd = random.Random(3)
    words = [f"t{int(rnd.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randrange(1, 60)))) for i in range(600)]
    docs += [(1000 + i, docs[i % 3][1]) for i in range(60)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.randrange(1, 12)))) for i in range(30)] + [(100, docs[0][1])]
    folder = work.workspace(spark, "search_test")
    shards = lexical.index(frame(spark, docs), folder, shard_bytes=5_000)
    assert shards.count() > 4
    got = lexical.search(shards, spark.createDataFrame(items, "item_id bigint, text string"), folder, k=5, query_bytes=200)
    assert found(got) == brute_search(docs, items, 5)


def test_search_stops_early():
    """Reading stops once the candidates are settled, with the scores that reading all gives."""
    rng = np.random.default_rng(4)
    read = []

    class Counted(lexical._Postings):
        def down_to(self, level):
            read.append((id(self), to := super().down_to(level)))
            return to

    terms = []
    for weight in (9000, 4000, 40, 5):
        docs = np.sort(rng.choice(5000, 2000 if weight < 100 else 40, replace=False))
        terms.append((Counted(docs, weight * rng.integers(1000, 400_000, len(docs))), 1))
    docs, scores = lexical.best(terms, 5000, 10)
    whole = np.zeros(5000, np.int64)
    for p, times in terms:
        whole[p.docs] += times * p.impacts
    assert len(docs) <= 40
    assert (scores == whole[docs]).all()
    assert set(np.argsort(-whole)[:10].tolist()) <= set(docs.tolist())
    assert dict(read)[id(terms[3][0])] < len(terms[3][0].docs)


# Rules -------------------------------------------------------------------------------------------------------------


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {p + k for own in windows.values() if len(own) > 1 for p in own for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words)


def rule_rows(df):
    return sorted([(r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in df.collect()], key=repr)


def test_rules_odd_rows(spark):
    rnd = random.Random(5)
    more = []
    for i in range(60):
        words = [rnd.choice("abc") * rnd.randrange(1, 3) for _ in range(rnd.randrange(5, 120))]
        if i % 2:
            words += words[: rnd.randrange(4, 30)]
        more.append((100 + i, " ".join(words)))
    docs = ODD + more
    assert rule_rows(rules.judged(frame(spark, docs))) == sorted([(d, brute_rules(t)) for d, t in docs], key=repr)
    assert rules.judged(frame(spark, [])).count() == 0


def test_rules_are_native(spark):
    plan = rules.judged(frame(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_rules_keep_prose_and_drop_junk(spark):
    out = {r.doc_id: r for r in queries.op12_quality_rules(spark, "/root/testdata/sf0.01").collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()]
    judged = [(q, out[d].kept) for d, q in labels if out[d].n_words >= 20]
    assert np.mean([k for q, k in judged if q == 1]) > 0.98
    assert np.mean([k for q, k in judged if q == 0]) < 0.1


def test_rule_tables(spark):
    with pytest.raises(ValueError):
        rules.compiled((rules.Rule("x", "n_nothing", high=1),))
    with pytest.raises(ValueError):
        rules.compiled((rules.Rule("x", "n_words", high=1), rules.Rule("x", "n_words", high=2)))
    only = (rules.Rule("few", "n_words", high=3), rules.Rule("words", "n_stop_words", "n_words", low=0.5, words=2))
    out = {r.doc_id: r.failed_rules for r in rules.judged(frame(spark, [(1, "the and of to"), (2, "the of"), (3, "stone water"), (4, "stone")]), only).collect()}
    assert out == {1: ["few"], 2: [], 3: ["words"], 4: []}


# Runs --------------------------------------------------------------------------------------------------------------


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(12, 2 * q) and all(any(w[i + k] != w[i + k + r] for k in range(length - r)) for r in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def digests(doc, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc is not None and n:
        h = zlib.crc32(str(doc).encode())
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        if h % 10 == 0:
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(found), *longest, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def run_rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()), key=repr)


def test_runs_odd_rows(spark):
    rnd, more = random.Random(6), []
    for i in range(200):
        letters = "ab" if i % 3 else "abcdefgh"
        words = [rnd.choice(letters) for _ in range(rnd.randrange(0, 70))]
        if i % 2 and words:
            a = rnd.randrange(len(words))
            p = 1 + (len(words) - a) // rnd.randrange(2, 9)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(len(words))]
        more.append((100 + i, " ".join(words)))
    a, b = "a", "a b"
    for _ in range(9):
        a, b = b, f"{b} {a}"
    docs = ODD + more + [(500, b), (501, "u " * 400), (502, "u " * 11)]
    docs = [(d, t if t is None or len(t) < 50_000 else t[:2000]) for d, t in docs]
    assert run_rows(periodic.run_digests(frame(spark, docs))) == sorted([digests(d, t) for d, t in docs], key=repr)
    assert periodic.run_digests(frame(spark, [])).count() == 0


def test_runs_spans(spark):
    out = periodic.periodic_runs(frame(spark, [(1, "x " + "a b c " * 5 + "y"), (2, "no runs here")])).collect()
    assert [tuple(r) for r in out[0].runs] == [(1, 15, 3)]
    assert out[0].collapsed == "x a b c y"
    assert (out[1].runs, out[1].collapsed, out[1].n_words) == ([], "no runs here", 3)


def test_op13(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    docs = [(d, t) for d, t in docs if len(t or "") < 6000]
    got = {r[0]: r for r in run_rows(queries.op13_periodic_runs(spark, DATA))}
    assert [got[d] for d, _ in docs] == [digests(d, t) for d, t in docs]
    assert sum(r[1] > 0 for r in got.values()) >= len(got) // 20
