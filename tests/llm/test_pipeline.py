"""The pipeline's stages on the smallest tables: what each keeps, changes and returns."""

from __future__ import annotations

import re

import corpus_pipeline
from pyspark.sql import functions as F
from test_documents import brute_repeats, brute_sets

from tracewell.llm import work

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    folder = work.workspace(spark, "test")
    outputs = {}
    for name, stage in corpus_pipeline.STAGES:
        docs_in, docs = docs, work.materialize(stage(spark, docs, DATA), f"{folder}/{name}")
        outputs[name] = docs
        if name != "packing":
            assert docs.columns == docs_in.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "suffix_dedup", "packing"]
    texts = {n: {r.doc_id: r.text for r in outputs[n].collect()} for n in names[:3]}
    everything = {r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rejected = everything - set(texts["quality"])
    assert sum(labels.get(d) == 1 for d in rejected) <= 1
    # 68 labels teach little; what is rejected is tested on the next larger tables below.
    assert sum(labels.get(d) == 0 for d in rejected) > sum(labels.get(d) == 0 for d in texts["quality"])
    # Of each group of near duplicates the smallest id stays.
    sets = brute_sets(sorted(texts["quality"].items()), 5)
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert set(texts["near_dedup"]) == {d for d in sets if find(d) == d}
    want = brute_repeats(list(texts["near_dedup"].items()))
    assert texts["suffix_dedup"] == {d: w[4].decode("utf-8", "ignore") for d, w in want.items()}
    assert outputs["suffix_dedup"].where(F.col("n_chars") != F.char_length("text")).count() == 0
    packed = outputs["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r.n for r in packed) <= 2048
    assert outputs["packing"].select("doc_id").distinct().count() == len(texts["suffix_dedup"])
    assert corpus_pipeline.ORACLE_SQL is None


def test_quality_stage_keeps_clean_documents_and_rejects_others(spark):
    larger = DATA.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{larger}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, larger).select("doc_id").collect()}
    assert sum(q == 1 and d not in kept for d, q in labels.items()) <= 1
    assert sum(q == 0 and d in kept for d, q in labels.items()) <= 1 < sum(q == 0 for q in labels.values())


def test_stages_take_nulls_and_repeats(spark):
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c d e f", "en", "s", 11), (3, "a b c d e f", "en", "s", 11), (None, "word " * 60, None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, odd, DATA)
        assert out.columns == odd.columns, name
        assert stage(spark, odd.limit(0), DATA).count() == 0
    assert corpus_pipeline.STAGES[1][1](spark, odd, DATA).where("doc_id is null").count() == 1
    assert corpus_pipeline.STAGES[3][1](spark, odd, DATA).count() == 5


def test_near_dedup_stage_without_ids(spark):
    text, other = "one two three four five six seven", "a b c d e f g h"
    rows = [(None, text, "x"), (None, text, "x"), (5, text, "x"), (None, other, "y"), (None, other, "y"), (None, "", "z"), (None, None, "z"), (7, "", "z")]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, kept_id string")
    out = corpus_pipeline.near_dedup_stage(spark, odd, DATA)
    assert out.columns == odd.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(5, text), (None, other), (None, ""), (None, None), (7, "")], key=str)


def test_stages_take_clashing_names(spark):
    names = ["quality_score", "body", "kept_id", "place", "shard", "score", "node", "payload"]
    wide = spark.createDataFrame([(i, f"some words of text {i} " * 9, 3, *(["v"] * len(names))) for i in range(4)], "doc_id bigint, text string, n_chars int, " + ", ".join(f"{n} string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, wide, DATA)
        assert out.columns == wide.columns and out.where("place = 'v' and node = 'v'").count() == out.count(), name
    assert corpus_pipeline.packing_stage(spark, wide, DATA).count() == 4


def test_near_dedup_joins_texts_alike_at_all_sizes(spark):
    rows = [(i, f"words of text number {i} that differ {i * 7} in many {i * 13} of their places {i * 17}") for i in range(20)]
    docs = spark.createDataFrame([(0, rows[0][1]), *((i + 100, t) for i, t in rows)], "doc_id bigint, text string")
    kept = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, *range(101, 120)]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin(\(skew=true\))? \[doc_id#\d+L\], \[kept_id#\d+L\], LeftSemi", plan)
