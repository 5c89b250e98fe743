"""The registered queries on the smallest tables, with production parameters, against SQL or brute force."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from compare import difference, duck
from test_documents import BYTE, WORD, as_map, brute_repeats, crc, ids_of
from tokenizers import Tokenizer

from tracewell.llm import packing, quality, queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    assert difference(name, queries.queries()[name], queries.oracle_sql()[name], spark, duck(DATA), DATA) is None


def test_op1(spark, texts):
    out = queries.op1_best_fit_packing(spark, DATA).collect()
    pieces = {(r.doc_id, r.piece): r for r in out}
    n = 0
    for doc, text in texts:
        ids = [*ids_of(WORD, text), 0]
        for k in range(-(-len(ids) // 2048)):
            part, r = ids[k * 2048 : (k + 1) * 2048], pieces[doc, k]
            assert (r.start, r.length, r.ids_crc32) == (k * 2048, len(part), crc(part))
            n += 1
    assert n == len(out)
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r.length for r in out) // 2048) + 2


def test_op4(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    out = as_map(queries.op4_quality_classifier(spark, folder))
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for d, r in out.items())
    good = [out[d].score for d in labels if out[d].held_out and labels[d] == 1]
    bad = [out[d].score for d in labels if out[d].held_out and labels[d] == 0]
    assert len(good) > 20
    assert len(bad) > 5
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.97


def test_op4_scores_equal_plain_loops():
    """Gated attention, passage by passage."""
    rng = np.random.default_rng(3)
    width, hidden, gates = 6, 5, 4
    model = quality.Model.__new__(quality.Model)
    model.weights = {k: rng.normal(size=n) for k, n in {"encode": (width, hidden), "encode_bias": hidden, "content": (hidden, gates), "gate": (hidden, gates), "attend": (gates, 1), "score": (hidden, 1), "score_bias": 1}.items()}
    model.mean, model.scale = rng.normal(size=width), rng.random(width) + 0.5
    bags = np.array([1, 3, 2])
    x = rng.normal(size=(6, width))
    got, w, at = model.forward(x, bags), model.weights, 0
    for d, n in enumerate(bags):
        own = np.tanh(((x[at : at + n] - model.mean) / model.scale) @ w["encode"] + w["encode_bias"])
        at += n
        raw = [float((np.tanh(h @ w["content"]) / (1 + np.exp(-(h @ w["gate"])))) @ w["attend"][:, 0]) for h in own]
        share = np.exp(raw) / np.exp(raw).sum()
        pooled = sum(s * h for s, h in zip(share, own, strict=True))
        assert got["score"][d] == pytest.approx(1 / (1 + np.exp(-(pooled @ w["score"][:, 0] + w["score_bias"][0]))))


def test_packing_keeps_clashing_columns(spark):
    pieces = spark.createDataFrame([(i % 3 or None, 0, 1 + i % 7, "s", "o", i) for i in range(40)], "doc_id bigint, piece int, length bigint, sequence_id string, Offset string, sequence_id_ int")
    out = packing.pack(pieces, capacity=10, patience=float("inf"))
    assert out.columns == [*pieces.columns, "sequence_id__", "offset_"]
    sequences = defaultdict(list)
    for r in out.collect():
        assert (r.sequence_id, r.Offset) == ("s", "o")
        sequences[r.sequence_id__].append((r.offset_, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 10
    assert packing.pack(pieces.limit(0)).count() == 0
    with pytest.raises(Exception, match="lengths are from 1"):
        packing.pack(pieces.withColumn("length", pieces.length * 0), capacity=10).collect()


def test_op5(spark, texts):
    out = as_map(queries.op5_media_columns(spark, DATA))
    same = {}
    for doc, text in texts:
        body = (text or "").encode()
        padded = body + b"\0" * (-len(body) % 64 if body else 64)
        r = out[doc]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(body), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert same.setdefault(text, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)


def test_op6(spark, texts):
    tokenizer, out = Tokenizer.from_file(WORD), as_map(queries.op6_bpe_word_table(spark, DATA))
    for doc, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        r = out[doc]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_op7(spark, texts):
    out, start = as_map(queries.op7_wavelet_tokens(spark, DATA)), 0
    tokenizer = Tokenizer.from_file(BYTE)
    for doc, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (out[doc].start, out[doc].n_tokens, out[doc].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_op8_beats_the_base_on_held_out_texts(spark, texts):
    out = as_map(queries.op8_pitman_yor_scores(spark, DATA))
    assert len(out) == len(texts) and len({r.train_tokens for r in out.values()}) == 1
    held = [r for r in out.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op10(spark, texts):
    want = brute_repeats(texts)
    for doc, r in as_map(queries.op10_suffix_array_dedup(spark, DATA)).items():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[doc][:4]
