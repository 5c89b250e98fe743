"""Operators on small cases computed by hand, and properties that must hold."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.functions import python_text, text, vectors
from tracewell.operators import attempts, axes, detectors, labeling, models, ratings, retrieval, sampling, shaping, statistics, traces


def levels(spark, *sequences):
    rows = [(k, i, x) for k, xs in enumerate(sequences) for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "k int, i int, x int")


def one(df):
    (row,) = df.collect()
    return row


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def doubles(*xs):
    return F.array(*(F.lit(float(x)) for x in xs)) if xs else F.array().cast("array<double>")


def test_jump_metrics(spark):
    rows = {r.k: r for r in traces.jump_metrics(levels(spark, [0, 2, 2, 1], [1]), ["k"], ["i"], "x").collect()}
    r = rows[0]
    assert (r.n_steps, r.jump_count, r.mean_abs_delta, r.max_jump, r.level_variance, r.direction_changes, r.jump_rate) == (4, 2, 1.0, 2, 0.6875, 1, 0.666667)
    r = rows[1]
    assert (r.jump_count, r.mean_abs_delta, r.max_jump, r.level_variance, r.direction_changes, r.jump_rate) == (0, 0.0, 0, 0.0, 0, 0.0)
    assert traces.jump_metrics(levels(spark), ["k"], ["i"], "x").count() == 0


def test_transitions(spark):
    m = traces.transition_features(traces.hard_transitions(levels(spark, [0, 0, 1, 2], [2]), ["k"], ["i"], "x"))
    rows = {r.k: r for r in m.collect()}
    r = rows[0]
    assert r.t_00 == r.t_01 == r.t_12 == pytest.approx(1 / 3)
    assert (r.self_loop_ratio, r.entropy, r.upward_ratio, r.shuttle) == (pytest.approx(1 / 3), pytest.approx(math.log2(3)), 1.0, 0.0)
    assert all(rows[1][c] == 0 for c in ("t_00", "t_22", "self_loop_ratio", "entropy", "upward_ratio", "downward_ratio"))
    soft = spark.createDataFrame([(0, 0, 1.0, 0.0, 0.0), (0, 1, 0.0, 0.5, 0.5)], "k int, i int, p0 double, p1 double, p2 double")
    r = one(traces.soft_transitions(soft, ["k"], ["i"], ["p0", "p1", "p2"]))
    assert (r.s_01, r.s_02, r.s_00) == (0.5, 0.5, 0.0)


@settings(max_examples=10, deadline=None)
@given(xs=st.lists(st.integers(0, 2), min_size=2, max_size=12))
def test_transition_cells_sum_to_one_and_reversal_keeps_jumps(spark, xs):
    df = levels(spark, xs, xs[::-1])
    for r in traces.hard_transitions(df, ["k"], ["i"], "x").collect():
        assert sum(r[f"t_{i}{j}"] for i in range(3) for j in range(3)) == pytest.approx(1)
    a, b = sorted(traces.jump_metrics(df, ["k"], ["i"], "x").collect())
    assert tuple(a)[1:] == tuple(b)[1:]


def test_token_f1_variants(spark):
    f1 = lambda f, a, b: value(spark, f(F.lit(a), F.lit(b)))
    assert f1(retrieval.token_f1_plain, "a b b", "b b c") == pytest.approx(2 / 3)
    assert [f1(f, "", "") for f in (retrieval.token_f1_plain, retrieval.token_f1_no_punctuation, retrieval.token_f1_content)] == [0.0, 1.0, 1.0]
    assert (f1(retrieval.token_f1_plain, "a, b", "a b"), f1(retrieval.token_f1_no_punctuation, "a, b", "a b")) == (0.5, 1.0)
    assert f1(retrieval.token_f1_content, "The über cat", "a cat über") == 1.0


def test_attribution_and_reciprocal_rank(spark):
    retrieved = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 1), (2, 21, 2), (2, 22, 3)], "query_id int, doc_id int, rank int")
    gold = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "query_id int, gold_id int")
    pairs = spark.createDataFrame([(1, 10, 1, 0.7), (1, 11, 1, 0.2), (2, 22, 2, 0.5)], "query_id int, doc_id int, gold_id int, f1 double")
    rows = {r.query_id: r for r in retrieval.attribution(retrieved, gold, pairs, 0.5).collect()}
    assert (rows[1].precision, rows[1].recall, rows[1].f1) == (0.5, 1.0, pytest.approx(2 / 3))
    assert rows[2].reciprocal_rank == pytest.approx(1 / 3)
    assert (rows[3].precision, rows[3].f1, rows[3].reciprocal_rank) == (0.0, 0.0, 0.0)
    soft = {r.query_id: r for r in retrieval.soft_attribution(retrieved, gold, pairs).collect()}
    assert (soft[1].soft_precision, soft[1].soft_recall) == (pytest.approx(0.45), 0.7)


def test_scores_in_a_group(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 5.0), (2, 1.0), (2, 3.0)], "q int, s double")
    assert sorted(r.v for r in df.select(retrieval.min_max("s", "q").alias("v")).collect()) == [0, 0, 0, 0, 1]
    c = spark.createDataFrame([("micro", "micro", 0.8), ("meso", "macro", 0.9), ("macro", "macro", 0.9), ("micro", "micro", 0.5)], "level string, predicted string, confidence double")
    assert c.limit(1).select(retrieval.boosted(F.lit(0.4)).alias("v")).first().v == pytest.approx(0.56)
    kept = [(r.level, r.predicted) for r in retrieval.routed_with_fallback(c).collect()]
    assert kept == [("micro", "micro"), ("meso", "macro"), ("micro", "micro")]


def test_ids_and_sections(spark):
    assert value(spark, text.parent_id(F.lit("p__micro__s2_p3_c1"))) == "p__meso__s2_p3"
    assert value(spark, text.parent_id(F.lit("p__micro__caption_c0"))) is None
    assert value(spark, text.id_level(F.lit("p__meso__s1"))) == "meso" and value(spark, text.id_level(F.lit("x"))) is None
    assert value(spark, text.section_level(F.lit("Methods ::: Experiments"))) == "micro"
    assert value(spark, text.section_level(F.lit("Epilogue"))) is None


def test_section_words_end_before_other_letters(spark):
    import duckdb

    names = ["Testß von", "ßtest", "éModel", "testé", "test_", "1test", "method\u017f", "\u017fystem", "a\u017fystem", "data\x0bquality", "data\tquality"]
    expression = lambda p: f"regexp_matches(s, '{p}')"
    sql = f"SELECT CASE WHEN {expression(text.MACRO_SECTION)} THEN 'macro' WHEN {expression(text.MESO_SECTION)} THEN 'meso' WHEN {expression(text.MICRO_SECTION)} THEN 'micro' END FROM (SELECT ? AS s)"
    want = {n: duckdb.execute(sql, [n]).fetchone()[0] for n in names}
    rows = spark.createDataFrame([(n,) for n in names], "s string")
    assert {r.s: r.level for r in rows.select("s", text.section_level(F.col("s")).alias("level")).collect()} == want
    assert want["Testß von"] == "micro"


@pytest.mark.parametrize(("n", "want"), [(6, [(1, 3), (3, 5), (5, 6)]), (3, [(1, 3)]), (1, [(1, 1)]), (0, []), (4, [(1, 3), (3, 4)]), (5, [(1, 3), (3, 5)])])
def test_sentence_chunks(spark, n, want):
    parts = F.array(*(F.lit(str(i)) for i in range(1, n + 1))).cast("array<string>")
    chunks = value(spark, text.sentence_chunks(parts))
    assert [(int(c[0]), int(c[-1])) for c in chunks] == want


def test_sentences_need_an_upper_case_letter(spark):
    assert value(spark, text.sentences(F.lit('One. Two! "Three?" four. 3.5 Five'))) == ["One.", 'Two!', '"Three?" four. 3.5 Five']


def test_length_matching(spark):
    rows = [(f"{b}{c}{i}", c, 10 * b + i % 10) for b, sizes in ((0, (4, 3, 7)), (1, (2, 9, 9))) for c, n in zip("xyz", sizes, strict=True) for i in range(n)]
    out = labeling.length_matched(spark.createDataFrame(rows, "id string, label string, words int"), "id", "label", "words")
    assert {(r.bucket, r.label): r["count"] for r in out.groupBy("bucket", "label").count().collect()} == {(0, "x"): 3, (0, "y"): 3, (0, "z"): 3}


def test_ranks_and_auc(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (20.0,), (30.0,)], "x double")
    assert sorted(r.v for r in df.select(statistics.average_rank("x").alias("v")).collect()) == [1, 2.5, 2.5, 4]
    scored = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, s double")
    assert one(statistics.auc(scored, "y", "s")).auc == 0.75
    assert one(statistics.auc(scored.where("y = 1"), "y", "s")).auc is None


@settings(max_examples=8, deadline=None)
@given(rows=st.lists(st.tuples(st.integers(0, 1), st.integers(-5, 5)), min_size=2, max_size=20))
def test_auc_of_negated_scores(spark, rows):
    df = spark.createDataFrame([(y, float(s)) for y, s in rows], "y int, s double")
    a = one(statistics.auc(df, "y", "s")).auc
    b = one(statistics.auc(df.withColumn("s", -F.col("s")), "y", "s")).auc
    assert (a is None and b is None) or a + b == pytest.approx(1)


def test_interpolation_and_shape(spark):
    assert value(spark, vectors.interpolate(doubles(0, 3), 4)) == [0, 1, 2, 3]
    assert value(spark, vectors.interpolate(doubles(7), 3)) == [7, 7, 7] and value(spark, vectors.interpolate(doubles(), 3)) == []
    assert value(spark, vectors.direction_changes(doubles(1, 0, -1, 1))) == 2
    assert value(spark, vectors.zero_crossings(doubles(0, 1, -1, 0, -2, 3))) == 2
    assert value(spark, vectors.zero_crossings(doubles())) == 0
    early, middle, late = (value(spark, m) for m in vectors.segment_means(doubles(*range(20)), 20))
    assert (early, middle, late) == (3, 10, 16.5)


def test_trajectory_features_against_numpy(spark):
    draw = np.random.default_rng(3)
    xs = draw.normal(size=11)
    x = np.interp(np.linspace(0, 1, 20), np.linspace(0, 1, 11), xs - xs.mean())
    df = spark.createDataFrame([([float(v) for v in xs],)], "raw array<double>").select(vectors.interpolate(vectors.centred(F.col("raw"))).alias("xs"))
    r = one(df.select(*(c.alias(n) for n, c in vectors.trajectory_features(F.col("xs"), "r").items())))
    d = np.diff(x)
    want = {"r_start": x[0], "r_std": x.std(), "r_total_variation": np.abs(d).sum(), "r_peak_pos": x.argmax() / 19, "r_max_drop": max(0, -d.min()), "r_max_rise_pos": d.argmax() / 18, "r_curvature_abs_mean": np.abs(np.diff(x, n=2)).mean(), "r_positive_mass": np.clip(x, 0, None).mean(), "r_time_negative": (x < 0).mean(), "r_late_mean": np.array_split(x, 3)[2].mean()}
    for name, v in want.items():
        assert r[name] == pytest.approx(v), name
    nothing = one(spark.range(1).select(doubles().alias("xs")).select(*(c.alias(n) for n, c in vectors.trajectory_features(F.col("xs"), "r").items())))
    assert all(v is None for v in nothing)


def test_vectors(spark):
    assert value(spark, vectors.cosine_distance(doubles(0, 0), doubles(1, 0))) == 0
    assert value(spark, vectors.cosine(doubles(1, 0), doubles(0, 2))) == 0
    pairs = F.array(*(F.array(F.lit(a), F.lit(b)) for a, b in ((0, 1), (1, 0), (1, 2))))
    assert value(spark, vectors.comparison_density(pairs, F.lit(3))) == pytest.approx(2 / 3)
    assert value(spark, vectors.comparison_density(pairs, F.lit(1))) is None
    assert value(spark, vectors.signed_confidence(F.lit(False), F.lit(70))) == -70


def test_detector_thresholds(spark):
    rows = [(i, 1, float(i)) for i in range(1, 11)] + [(11, 0, 9.2), (12, 0, 9.1)]
    df = spark.createDataFrame(rows, "id int, target int, reasoning_n_chunks double")
    flagged = detectors.flags(detectors.scores(df, "id", "target", {"rambling_overlong": detectors.DETECTORS["rambling_overlong"]}), "target")
    assert flagged.first().threshold == pytest.approx(9.1)
    assert {r.id for r in flagged.where("flag").collect()} == {10, 11}
    few = df.where("target = 0 or id <= 2")
    with pytest.raises(ValueError, match="answer_max_rise"):
        detectors.scores(few, "id", "target")
    overlong = {"rambling_overlong": detectors.DETECTORS["rambling_overlong"]}
    quantile = detectors.thresholds(detectors.scores(few, "id", "target", overlong), "target").where("detector = 'rambling_overlong'").first().threshold
    assert quantile == pytest.approx(np.quantile([1, 2, 9.2, 9.1], 0.9))
    assert [value(spark, text.truncated(F.lit(s))) for s in ("Exit_Cost", "done", None)] == [1, 0, None]


def test_votes_and_best_attempt(spark):
    df = spark.createDataFrame([(1, i, a, a is not None, a == "A", s) for i, (a, s) in enumerate((("A", None), ("B", 0.2), ("B", 0.2), ("A", 0.1)))], "id int, run_order int, answer string, answered boolean, correct boolean, score double")
    r = one(attempts.plurality_vote(df, "id", "answer", "run_order", "correct"))
    assert (r.answer, r.votes, r.consistency, r.vote_correct) == ("A", 2, 0.5, True)
    assert one(attempts.best_attempt(df, "id", "score", "answered", "run_order")).run_order == 1


def test_coverage_and_risk(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (2, 1, 0.8), (3, 0, 0.7), (4, 0, 0.6)], "id int, y int, s double")
    rows = {round(r.coverage, 2): r for r in attempts.coverage_risk(df, "s", "y", "id", 4).collect()}
    assert (rows[0.5].accuracy, rows[0.5].risk, rows[1.0].accuracy) == (1.0, 0.0, 0.5)


def test_matching_of_values_and_answers(spark):
    match = lambda a, b: value(spark, text.values_match(F.lit(a), F.lit(b)))
    assert match("0.874", "87.4") and match("1,000", "1000%") and match("0", "0.0") and not match("abc", "5") and not match(None, "5") and not match("3", "0")
    assert [value(spark, text.yes_no(F.lit(s))) for s in ("Yes, it does", "no", "yes and no", "perhaps")] == [True, False, True, None]
    assert value(spark, text.same_metric(F.lit("F1-score"), F.lit("f-measure"))) and not value(spark, text.same_metric(F.lit("BLEU"), F.lit("accuracy")))
    assert value(spark, text.arxiv_id(F.lit("https://arxiv.org/pdf/2301.12345v2"))) == "2301.12345" and value(spark, text.arxiv_id(F.lit("x"))) is None
    assert value(spark, text.final_answer(F.lit("FINAL ANSWER: a\nfinal answer: b "))) == "b"
    assert value(spark, text.choice_letter(F.lit("the answer is (c)"))) == "C"
    assert value(spark, text.pair_key(F.lit("a"), F.lit("b"))) == value(spark, F.substring(F.md5(F.lit("a\x00b")), 1, 16))
    items = value(spark, text.rubric_items(F.lit("Points: 2, Item: one\nPoints: 0.5 , Item: two words")))
    assert [(i["points"], i["description"]) for i in items] == [(2.0, "one"), (0.5, "two words")]
    inside, outside = text.split_thinking(F.lit("<think> a </think>b<think>c</think>"))
    assert (value(spark, inside), value(spark, outside)) == ("a\nc", "b")


def test_records(spark):
    chunks = F.array(*(F.lit(c) for c in "abcde"))
    assert value(spark, text.error_step(F.lit("5"), F.slice(chunks, 1, 3))) == 2 and value(spark, text.error_step(F.lit("0"), chunks)) == 0
    assert value(spark, text.coalesce_chunks(chunks, 2)) == ["a\n\nb", "c\n\nd\n\ne"] and value(spark, text.coalesce_chunks(chunks, 9)) == list("abcde")
    votes = lambda *v: F.array(*(F.lit(x) for x in v))
    assert [value(spark, shaping.annotator_majority(v)) for v in (votes(True, False, False), votes(False, True))] == [False, False]
    assert value(spark, shaping.rubric_total(doubles(5, -1, 1), doubles(2, 3, 4))) == 3
    assert value(spark, shaping.guarded_ratio(F.lit(1.0), F.lit(0.0))) is None
    options, letter = shaping.shuffled_choices(F.lit("q"), F.lit("right"), F.array(F.lit("w1"), F.lit("w2"), F.lit("w3")))
    assert value(spark, options)["ABCD".index(value(spark, letter))] == "right"


def test_best_fuzzy_match(spark):
    e = spark.createDataFrame([("p", 1, "SQuAD 2", "F1", "87.4"), ("q", 2, "x", "y", "1")], "paper string, x int, dataset string, metric string, value string")
    t = spark.createDataFrame([("p", 0, "other", "f1", "0.874"), ("p", 1, "squad", "f1-score", "0.874"), ("p", 2, "squad", "f1", "87")], "paper string, position int, dataset string, metric string, value string")
    rows = {r.x: r for r in shaping.best_fuzzy_match(e, t, "paper", "x", "position").collect()}
    assert (rows[1].matched, rows[1].score, rows[1].correct) == (1, 3, True) and (rows[2].matched, rows[2].score, rows[2].correct) == (None, 0, False)


def test_kappa(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "b"), ("a", "a"), ("b", "b")], "x string, y string")
    assert one(statistics.kappa(df, "x", "y")).kappa == 1.0
    assert one(statistics.kappa(df.where("x = 'a'"), "x", "y")).kappa == 1.0
    crossed = spark.createDataFrame([("a", "b"), ("b", "a")], "x string, y string")
    assert one(statistics.kappa(crossed, "x", "y")).kappa == -1.0


def test_p_values():
    assert statistics.normal_p(1.959963985) == pytest.approx(0.05)
    assert statistics.t_p(2.228138852, 10) == pytest.approx(0.05, abs=1e-6)
    assert statistics.chi_square_p(3.841458821, 1) == pytest.approx(0.05, abs=1e-6) and statistics.chi_square_p(18.30703805, 10) == pytest.approx(0.05, abs=1e-6)
    assert statistics.correlation_p(None, 50) is None and statistics.correlation_p(1.0, 50) == 0 and statistics.correlation_p(0.1, 20, 30) == 1.0


def test_ratings_are_centred_and_symmetric():
    matches = [(0, 1, "a"), (1, 2, "a"), (0, 2, "tie"), (2, 1, "b")]
    mu, sigma = ratings.fit(3, matches)
    assert mu.sum() == pytest.approx(0) and mu[0] > mu[1] > mu[2] and (sigma < ratings.SIGMA).all()
    swapped = [(b, a, {"a": "b", "b": "a"}.get(o, o)) for a, b, o in matches]
    assert ratings.fit(3, swapped)[0] == pytest.approx(mu)
    assert ratings.fit(1, matches)[0].tolist() == [0.0] and ratings.fit(3, [])[0].tolist() == [0.0] * 3
    # One game from the start: both move by the same amount.
    mu, sigma = np.full(2, ratings.MU), np.full(2, ratings.SIGMA)
    ratings.update(mu, sigma, 0, 1, "a")
    c = math.sqrt(2 * ratings.SIGMA**2 + 2 * ratings.BETA**2)
    assert mu[0] - ratings.MU == pytest.approx(ratings.SIGMA**2 / c * 0.5) and mu[0] + mu[1] == pytest.approx(2 * ratings.MU)


def test_tournament_budget_and_order():
    played = ratings.tournament(["a", "bb", "ccc", "dddd"], ratings.longer, 5)
    assert [m[:2] for m in played[:3]] == [(0, 1), (1, 2), (2, 3)] and len(played) == 5 and len({frozenset(m[:2]) for m in played}) == 5
    assert len(ratings.tournament(["a", "bb", "ccc"], ratings.longer, 50)) == 3 and ratings.tournament([], ratings.longer, 5) == []
    assert ratings.compare(lambda a, b: "a", "x", "y") == "tie"


def test_splits_are_exact_and_disjoint(spark):
    df = spark.range(300).select("id", (F.col("id") % 3).alias("label"), (F.col("id") % 20).alias("g"))
    split = sampling.stratified_split(df, "label", "id", [("train", 0.7), ("val", 0.15), ("test", 0.15)])
    assert {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()} == {(k, s): n for k in range(3) for s, n in (("train", 70), ("val", 15), ("test", 15))}
    for grouped in (sampling.group_split(df, "g", [("a", 0.5), ("b", 0.5)]), sampling.majority_group_split(df, "g", "label", [("a", 0.5), ("b", 0.5)])):
        assert grouped.count() == 300 and sampling.leaking_groups(grouped, "g").count() == 0
    folds = sampling.stratified_folds(df, "label", "id").groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [60] * 5
    assert sampling.allocate({"a": 50, "b": 30, "c": 20}, 10) == {"a": 5, "b": 3, "c": 2} and sampling.allocate({}, 3) == {}
    sample = sampling.proportional_sample(df.withColumn("s", F.when(F.col("id") < 150, "x").otherwise("y")), "s", 20, "id")
    assert {r.s: r["count"] for r in sample.groupBy("s").count().collect()} == {"x": 10, "y": 10}
    pools = sampling.priority_quota_sample(df, [("low", F.col("id") < 10, 4), ("even", F.col("id") % 2 == 0, 6)], "id")
    assert {r.pool: r["count"] for r in pools.groupBy("pool").count().collect()} == {"low": 4, "even": 6}
    assert sampling.group_sample(df, "g", 3).select("g").distinct().count() == 3


def test_axes(spark):
    rows = [(0, [0.0, 0.1]), (0, [0.0, -0.1]), (1, [1.0, 0.0]), (2, [2.0, 0.1]), (2, [2.0, -0.1])]
    df = spark.createDataFrame(rows, "label int, v array<double>")
    axis = axes.centroid_axis(df, "label", "v", 0, 2)
    assert axis == pytest.approx([1, 0]) and axes.discriminant_axis(df, "label", "v", 0, 2)[0] > 0.99
    assert axes.axis_cosine(axis, np.array([0.0, 1.0])) == 0 and axes.axis_cosine(axis, np.zeros(2)) == 0
    assert all(r.ordered for r in axes.validate_axis(df.select("label", axes.project(F.col("v"), axis).alias("p")), "label", "p", 0, 1, 2).collect())
    with pytest.raises(ValueError):
        axes.centroid_axis(df.withColumn("v", F.array(F.lit(1.0))), "label", "v", 0, 2)
    steps = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [1.0, 1.0]), (1, 2, [3.0, 1.0]), (2, 0, [1.0, 1.0])], "t int, i int, v array<double>")
    out = {r.t: r for r in axes.axis_features(steps, "t", "i", "v", axis).collect()}
    assert (out[1].axis_drift_max, out[1].axis_direction, out[1].orthogonal_drift_mean) == (2.0, 1.0, 0.5) and out[2].axis_drift_mean is None and out[2].axis_direction is None


def test_partial_correlation_against_numpy(spark):
    draw = np.random.default_rng(5)
    z = draw.normal(size=60)
    rows = [(1, float(a), float(b), float(c)) for a, b, c in zip(z + draw.normal(size=60), z + draw.normal(size=60), z, strict=True)]
    r = one(models.partial_spearman(spark.createDataFrame(rows, "g int, x double, y double, z double"), "g", "x", "y", ["z"]))
    rank = lambda v: np.argsort(np.argsort(v)) + 1.0
    data = np.array(rows)[:, 1:]
    design = np.column_stack([np.ones(60), rank(data[:, 2])])
    rest = [rank(np.round(rank(c) - design @ np.linalg.lstsq(design, rank(c), rcond=None)[0], 9)) for c in (data[:, 0], data[:, 1])]
    assert r.rho == pytest.approx(np.corrcoef(*rest)[0, 1])


def test_labels_of_paragraphs(spark):
    rows = [("a", "This is plain. Nothing here.", "Introduction", 0, 5), ("b", "See Table 3 and Figure 2. Accuracy of 91.5 (Smith 2019).", "Methods", 1, 5), ("c", "Words only.", "Unknown", 2, 5), ("d", "", "Results", 0, 1)]
    out = {r.span_id: r for r in labeling.label_paragraphs(spark.createDataFrame(rows, "span_id string, text string, section_name string, paragraph_index int, total_paragraphs int")).collect()}
    assert (out["a"].label, out["a"].label_source, out["a"].confidence) == ("macro", "position", 0.9)
    assert out["b"].label == "micro" and out["b"].micro_score > 0.3
    assert (out["c"].label, out["c"].confidence) == ("meso", 0.3)
    assert (out["d"].label, out["d"].sentence_count) == ("meso", 0)


def test_python_text(spark):
    assert python_text.matching_ratio("abcd", "bcde") == 0.75 and python_text.matching_ratio(None, "") == 1.0
    assert python_text.vote_form(" “x²”. ") == "“x2”" and python_text.vote_form(None) is None
    assert python_text.subsequence_f("a b c d", "a c e") == pytest.approx(4 / 7) and python_text.subsequence_f("", "a") == 0
    assert spark.range(1).select(python_text.normalize_decomposed(F.lit("É  x")).alias("v")).first().v == "é x"


def test_neighbours_of_missing_and_odd_vectors(spark):
    rows = [(1, "a", [0.0, 1.0]), (2, "a", [0.0, 0.9]), (3, "b", [5.0, 5.0]), (4, "a", None), (5, "a", [float("nan"), 1.0]), (6, "a", [None, 1.0]), (7, "a", [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, label string, embedding array<double>")
    found = {r.vec_id: r.purity for r in retrieval.neighbour_purity(df, "label", k=1).collect()}
    assert found == {1: 1.0, 2: 1.0, 3: 0.0, 4: None, 5: None, 6: None, 7: None}


def test_exact_quantiles(spark):
    draw = np.random.default_rng(4)
    values = [None, *draw.integers(0, 20, 300).tolist(), *draw.normal(size=200).round(3).tolist()]
    rows = [("ab"[i % 2], None if v is None else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, x double")
    for p in (0.0, 0.1, 0.5, 0.9, 1.0):
        whole = one(statistics.quantile(df, "x", p)).quantile
        assert whole == pytest.approx(np.quantile([x for _, x in rows if x is not None], p))
        parts = {r.g: r.quantile for r in statistics.quantile(df, "x", p, ["g"]).collect()}
        assert parts["a"] == pytest.approx(np.quantile([x for g, x in rows if g == "a" and x is not None], p))


def test_unique_rows_raise_on_duplicates(spark):
    df = spark.createDataFrame([(1, 2), (3, 4)], "k int, v int")
    assert shaping.unique_rows(df, ["k"]).count() == 2
    with pytest.raises(Exception, match="duplicate key 1"):
        shaping.unique_rows(df.union(df), ["k"]).where("k = 1").collect()


def test_discriminant_axis_separates(spark):
    draw = np.random.default_rng(6)
    rows = [(k % 2 * 2, [float(k % 2 * 2 + draw.normal() * 0.1), float(draw.normal() * 5)]) for k in range(200)]
    df = spark.createDataFrame(rows, "lvl int, v array<double>")
    axis = axes.discriminant_axis(df, "lvl", "v", 0, 2)
    assert axis[0] > 0.99 and abs(axis[1]) < 0.05


def test_long_traces_are_centred_in_one_pass(spark):
    """60,000 values: a mean per value took hours."""
    xs = F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: i.cast("double"))
    got = spark.range(1).select(xs.alias("xs")).select(vectors.interpolate(vectors.centred(F.col("xs")), 20).alias("v")).first().v
    assert got == pytest.approx(np.linspace(-29_999.5, 29_999.5, 20).tolist())
    assert spark.range(1).select(vectors.interpolate(vectors.centred(F.array().cast("array<double>"))).alias("v")).first().v == []


def test_fuzzy_match_compares_distinct_rows(spark):
    """20,000 copies on both sides: 400 million pairs, if each was compared."""
    ids = spark.range(20_000)
    kind = F.when(F.col("id") % 2 == 0, "a b").otherwise(None)
    e = ids.select(F.lit("p").alias("paper"), F.col("id").alias("x"), kind.alias("dataset"), F.lit("acc").alias("metric"), F.lit("90").alias("value"))
    t = ids.select(F.lit("p").alias("paper"), (F.col("id") + 7).alias("position"), F.lit("a").alias("dataset"), F.lit("acc").alias("metric"), F.lit("0.9").alias("value"))
    rows = shaping.best_fuzzy_match(e, t, "paper", "x", "position")
    got = rows.groupBy("score", "matched", "correct").count().orderBy("score").collect()
    assert [tuple(r) for r in got] == [(2, 7, False, 10_000), (3, 7, True, 10_000)]


def test_numbers_are_read_before_rows_are_paired(spark):
    from tracewell.plans import queries

    plan = queries()["q_fuzzy_numeric_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan[: plan.index("Join")]
