"""Searches in tiles against all pairs, and on vectors without a score."""

from __future__ import annotations

import inspect

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.operators import retrieval, tiles
from tracewell.plans import queries, retrieval_queries

SECOND = retrieval_queries._bm25_of_vectors


def sides(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, level string, v array<float>")
    return df.where("id % 10 = 0").select("id", "v"), df


@pytest.fixture
def small(monkeypatch):
    for name, size in (("ROWS", 16), ("QUERIES", 4), ("FEWEST", 4), ("PAIRS", 40)):
        monkeypatch.setattr(tiles, name, size)


def test_best_rows_are_those_of_all_pairs(spark, small):
    draw = np.random.default_rng(3)
    v = draw.normal(size=(90, 5)).astype(np.float32)
    v[40:60] = v[20]  # ties
    rows = [(i, ["macro", "micro", None][i % 3], v[i].tolist()) for i in range(90)]
    q, r = sides(spark, rows)
    x = v.astype(float)
    dot = x @ x.T
    size = np.sqrt(np.diag(dot))
    cosine, bm25 = np.round(np.clip(dot / np.outer(size, size), -1, 1), 9), np.round(dot / 10 + np.arange(90) % 7, 9)
    scaled = lambda a: (a - a.min()) / (a.max() - a.min())
    for weight in (None, 0.7):
        found = tiles.best(q, r, 4, SECOND, weight, per_level=True)
        top = {(t.query_id, t.rank): t.doc_id for t in retrieval.top_k(found, "cosine" if weight is None else "x", 4).collect()}
        for i in range(0, 90, 10):
            others = [j for j in range(90) if j != i]
            score = cosine[i, others] if weight is None else np.round(weight * scaled(cosine[i, others]) + (1 - weight) * scaled(bm25[i, others]), 9)
            want = [others[j] for j in np.lexsort((others, -score))[:4]]
            assert [top[i, n] for n in range(1, 5)] == want
    means = {(t.query_id, t.level): t.mean for t in tiles.level_means(q, r).collect()}
    assert means[10, "macro"] == pytest.approx(cosine[10, [j for j in range(0, 90, 3) if j != 10]].mean())


def test_pairs_without_a_score_come_last(spark):
    rows = [(0, "a", [1.0, 0.0]), (1, "a", None), (2, "a", [1.0, 1.0, 1.0]), (3, "a", [float("nan"), 1.0]), (4, "a", [-1.0, 0.0]), (5, "a", [0.0, 0.0])]
    q, r = sides(spark, rows)
    top = retrieval.top_k(tiles.best(q, r, 9, SECOND), "cosine", 9).orderBy("rank").collect()
    assert [(t.doc_id, t.cosine) for t in top] == [(5, 0.0), (4, -1.0), (1, None), (2, None), (3, None)]


def test_no_search_makes_a_row_of_every_pair(spark):
    assert "against_all" not in inspect.getsource(retrieval_queries.candidates)
    data = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{data}/embeddings.parquet").count()
    asked = spark.read.parquet(f"{data}/embeddings.parquet").where("vec_id % 100 = 0").count()
    sent = retrieval_queries.candidates(spark, data, 5).groupBy().agg(F.count("*").alias("n")).first().n
    assert sent < asked * n / 2
    assert queries()["q_naive_hybrid"](spark, data).count() == 5 * asked


def test_nearest_by_products_are_those_of_distances(spark):
    draw = np.random.default_rng(8)
    v = draw.normal(size=(400, 6)) * 100
    v[100:300] = v[7] + draw.integers(0, 3, size=(200, 6)) * 1e-7  # near copies, whose products cancel
    rows = [(i, str(i % 3), v[i].tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id bigint, label string, embedding array<double>")
    for block in (64, 32_768):
        found = {r.vec_id: r.purity for r in retrieval.neighbour_purity(df, "label", 15, block=block).collect()}
        for i in range(400):
            distance = np.round(np.sqrt(((v - v[i]) ** 2).sum(1)), 6)
            near = [j for j in np.lexsort((np.arange(400), distance)) if j != i][:15]
            assert found[i] == pytest.approx(np.mean([j % 3 == i % 3 for j in near]))


def test_tiles_of_neighbours_are_bounded(monkeypatch):
    v = np.random.default_rng(1).normal(size=(300, 4))
    monkeypatch.setattr(tiles, "PAIRS", 3_000)
    parts = list(tiles.nearest_of_rows(v, np.arange(300), v, np.arange(300), 5))
    assert [first for first, *_ in parts] == list(range(0, 300, 10)) and sum(len(r) for _, r, *_ in parts) == 1500


def test_means_by_sums_are_those_of_all_pairs(spark, small):
    draw = np.random.default_rng(5)
    rows = [(i, ["macro", "micro", None][i % 3], draw.normal(size=5).tolist()) for i in range(90)]
    rows += [(10, "micro", [1.0] * 5), (91, "macro", None), (92, "macro", [1.0, 2.0]), (100, "micro", [2.0, 1.0]), (101, "micro", [0.0] * 5), (110, "micro", None), (120, "macro", [float("inf")] * 5)]
    q, r = sides(spark, rows)
    found, want = ({(t.query_id, t.level): t.mean for t in df.collect() if t.mean is not None} for df in (tiles.level_means_by_sums(q, r), tiles.level_means(q, r)))
    assert found.keys() == want.keys() and (100, "macro") in found
    assert all(found[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_paired_conditions_pairs_only_queries_whose_last_digit_is_unsure(spark, monkeypatch):
    data, asked = "/root/testdata/sf0.001", []
    pairs = tiles.level_means
    monkeypatch.setattr(tiles, "level_means", lambda q, r: asked.append(q.count()) or pairs(q, r))
    assert queries()["q_paired_conditions"](spark, data).count() == 5
    assert sum(asked) <= 1


def test_paired_conditions_where_rounding_turns_the_last_digit(spark, tmp_path):
    x = np.random.default_rng(2).uniform(0.1, 0.9, size=(400_000, 3)).astype(np.float32)
    cosine = x / np.sqrt(x.astype(float) ** 2 + 1)
    plain, rounded = cosine.mean(1), cosine.round(9).mean(1)
    turned = np.flatnonzero((plain.round(6) != rounded.round(6)) & (np.abs(rounded * 1e6 % 1 - 0.5) > 1e-5))
    for n, i in enumerate(turned[:3]):
        rows = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 0), *((2 + j, [float(v), 1.0], 2) for j, v in enumerate(x[i]))]
        spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/{n}/embeddings.parquet")
        found = queries()["q_paired_conditions"](spark, f"{tmp_path}/{n}").collect()
        assert [(t.query_id, t.difference) for t in found] == [(0, round(rounded[i], 6))]
    assert len(turned) >= 3


def test_only_rows_near_the_best_get_a_cosine(monkeypatch):
    draw = np.random.default_rng(4)
    v = draw.normal(size=(3_000, 8)).astype(np.float32)
    v[500:600] = v[3]  # ties
    level = [["macro", "micro", None][i % 3] for i in range(3_000)]
    asks = [(i, v[i].tolist(), None, True, [None, "micro"][i % 2]) for i in range(40)]
    rows = asks + [(i, v[i].tolist(), level[i], False, None) for i in range(3_000)]
    table = pa.table(dict(zip(("id", "v", "level", "asks", "only"), (list(c) for c in zip(*rows)))))
    x = v.astype(float) / np.sqrt((v.astype(float) ** 2).sum(1))[:, None]
    cosine = (x[:40] @ x.T).round(9)
    paired = []
    monkeypatch.setattr(tiles.np, "lexsort", lambda keys, sort=np.lexsort: paired.append(len(keys[0])) or sort(keys))
    for per_level in (False, True):
        found = [t for part in tiles.nearest_by_cosine(table, 6, per_level) for t in zip(*(x.tolist() for x in part))]
        monkeypatch.undo()
        for i in range(40):
            for name in ["micro"] if i % 2 else ["macro", "micro", None] if per_level else [""]:
                ids = np.array([j for j in range(3_000) if name == "" or level[j] == name])
                want = ids[np.lexsort((ids, -cosine[i, ids]))[:6]].tolist()
                got = [(d, c) for q, d, lv, _, c in found if q == i and name in ("", lv)]
                assert [d for d, _ in got] == want and [c for _, c in got] == pytest.approx(cosine[i, want], abs=2e-9)
    assert sum(paired) < 40 * 3_000 / 10


def test_routed_queries_are_searched_in_their_level(spark):
    data = "/root/testdata/sf0.001"
    found = retrieval_queries.candidates(spark, data, 5, only=retrieval.searched_level())
    routed = found.where("coalesce(confidence, 1) >= 0.6")
    assert routed.count() > 0 and routed.where(F.col("level") != retrieval.effective_level(F.col("predicted"))).count() == 0
    assert queries()["q_level_routed_v2"](spark, data).count() == 25


def test_scores_of_nine_digits_are_rounded_as_in_sql(spark):
    scores = [0.5047875, -0.5047875, *((np.random.default_rng(6).integers(-1_000_000, 1_000_000, 2_000) * 1_000 + 500) / 1e9).tolist()]
    rows = spark.createDataFrame([(i, i, s) for i, s in enumerate(scores)], "query_id long, doc_id long, x double")
    found = [t.score for t in retrieval_queries._ranked(rows, F.col("x")).orderBy("query_id").collect()]
    con = duckdb.connect()
    assert found == [con.execute("SELECT round(?::DOUBLE, 6) + 0.0", [s]).fetchone()[0] for s in scores]
