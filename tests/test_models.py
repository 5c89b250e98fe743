"""Fitted models against brute force: boosted trees, convolutions, ridge with many outputs, weighted bootstraps, failure types, archives."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import tracewell
from tracewell.operators import attribution, boosting, detectors, gram, labeling, models, resampling, retrieval, series, specs
from tracewell.sources import archives


@pytest.fixture(scope="module")
def session(spark):
    tracewell.on_workers(spark)
    return spark


def table(n=240, seed=1, gaps=0.1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(2)
    y = ((x[:, 0] + x[:, 1] ** 2 + rng.normal(size=n) * 0.3) > 0.7).astype(int)
    x[rng.random(x.shape) < gaps] = np.nan
    return x, y


def frame(spark, x, y, parts=3):
    rows = [(i, float(t), *(None if np.isnan(v) else float(v) for v in r)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id bigint, y double, a double, b double, c double").repartition(parts, "id")


COLUMNS = ["a", "b", "c"]


def plain_gain(g, h, left):
    score = lambda m: g[m].sum() ** 2 / h[m].sum()
    return score(left) + score(~left) - score(np.ones(len(g), bool))


def plain_best(x, g, h, rows, least):
    """The best split of some rows by trying every value of every column, missing values on either side."""
    best = None
    for j in range(x.shape[1]):
        for v in np.unique(x[rows, j][~np.isnan(x[rows, j])]):
            for missing_left in (False, True):
                left = np.where(np.isnan(x[rows, j]), missing_left, x[rows, j] <= v)
                if min(left.sum(), (~left).sum()) >= least:
                    gain = plain_gain(g[rows], h[rows], left)
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, rows[left], rows[~left])
    return best


def plain_tree(x, g, h, leaves, least):
    """Leaves as row sets, always parting the leaf of largest gain."""
    open_ = [(plain_best(x, g, h, np.arange(len(x)), least), np.arange(len(x)))]
    while len(open_) < leaves:
        k = max(range(len(open_)), key=lambda i: open_[i][0][0] if open_[i][0] else -1)
        best, _ = open_[k]
        if not best or best[0] <= 1e-10:
            break
        open_[k : k + 1] = [(plain_best(x, g, h, part, least), part) for part in best[1:]]
    return {tuple(sorted(rows.tolist())) for _, rows in open_}


def test_tree_equals_brute_force(session):
    """The first tree parts the rows as a search over all values does, with its leaf values."""
    x, y = table()
    settings = boosting.Boosting(trees=1, leaves=6, least_rows=10, bins=1000)
    forest = boosting.fit(frame(session, x, y), "y", COLUMNS, settings)
    tree = forest.trees[0]
    node = tree.route(boosting.binned(x, forest.cuts), np.zeros(len(x), np.int64))
    found = {tuple(np.flatnonzero(node == k).tolist()) for k in np.unique(node)}
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))
    assert found == plain_tree(x, g, h, 6, 10)
    for k in np.unique(node):
        assert tree.value[k] == pytest.approx(-0.05 * g[node == k].sum() / h[node == k].sum())


@pytest.mark.parametrize("task", ["binary", "squares"])
def test_blocks_give_the_same_trees(session, task):
    x, y = table(seed=2)
    df, settings = frame(session, x, y if task == "binary" else y + x[:, 0].round(1) * 0.1, 4).where("y is not null and not isnan(y)"), boosting.Boosting(task=task, trees=2, leaves=5)
    one, many = boosting.fit(df, "y", COLUMNS, settings), boosting.fit(df, "y", COLUMNS, settings, block_rows=40)
    for a, b in zip(one.trees, many.trees, strict=True):
        assert (a.column, a.bin, a.missing_left, a.left) == (b.column, b.bin, b.missing_left, b.left)
        assert a.value == pytest.approx(b.value)
    assert one.gain == pytest.approx(many.gain)


def test_a_large_table_is_fitted_by_few_jobs(session):
    """120,000 rows: a tree's passes are no jobs of their own."""
    df = session.range(120_000).selectExpr("id", "cast(id % 1000 > 300 as double) y", "(id * 7919) % 1000 / 10.0 a", "id % 1000 + 0.0 b")
    session.sparkContext.setJobGroup("large", "boosting")
    forest = boosting.fit(df, "y", ["a", "b"], boosting.Boosting(trees=3, leaves=8))
    jobs = session.sparkContext.statusTracker().getJobIdsForGroup("large")
    session.sparkContext._jsc.clearJobGroup()
    assert 0 < len(jobs) <= 8 and len(forest.trees) == 3 and forest.gain[1] > forest.gain[0]


def test_boosting_learns_and_counts_gains(session):
    x, y = table(600, 3)
    forest = boosting.fit(frame(session, x, y), "y", COLUMNS, boosting.Boosting(trees=60))
    out = boosting.predicted(frame(session, x, y), forest, COLUMNS).select("y", "prob").collect()
    assert np.mean([(r.prob >= 0.5) == (r.y == 1) for r in out]) > 0.95
    assert forest.gain[2] < min(forest.gain[0], forest.gain[1])
    assert all(len(t.column) <= 61 for t in forest.trees)
    with pytest.raises(ValueError):
        boosting.fit(frame(session, x, y).where("id < 0"), "y", COLUMNS)


def test_boosted_constant_and_missing_columns(session):
    df = session.createDataFrame([(i, float(i % 2), 1.0, None) for i in range(40)], "id bigint, y double, a double, b double")
    forest = boosting.fit(df, "y", ["a", "b"], boosting.Boosting(trees=5))
    assert [r.prob for r in boosting.predicted(df, forest, ["a", "b"]).collect()] == pytest.approx([0.5] * 40)


# Convolutions --------------------------------------------------------------------------------------------------------


def plain_output(x, places, dilation, inner):
    out = []
    for t in range(len(x)):
        taps = [t + (k - 4) * dilation for k in range(9)]
        if inner and (taps[0] < 0 or taps[-1] >= len(x)):
            continue
        out.append(sum((2 if k in places else -1) * (x[i] if 0 <= i < len(x) else 0.0) for k, i in enumerate(taps)))
    return np.array(out)


def test_convolutions_equal_plain_loops(session):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(7, 20))
    model = series.Convolutions.fit(rng.normal(size=(5, 20)), 84 * 6)
    got = model.transform(x)
    assert got.shape == (7, 84 * 6)
    want = []
    for dilation, biases in model.biases:
        for number, places in enumerate(itertools.combinations(range(9), 3)):
            outs = [plain_output(row, places, dilation, number % 2 == 1 and 20 > 8 * dilation) for row in x]
            want += [[np.mean(o > b) for o in outs] for b in biases[number]]
    assert np.allclose(got, np.array(want).T)
    df = session.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(9, None)], "id int, s array<double>")
    out = {r.id: r.f for r in df.select("id", series.features_of(model, "s").alias("f")).collect()}
    assert out[9] is None
    assert np.allclose([out[i] for i in range(7)], got)


def test_dilations_and_flat_series():
    for length, n in ((20, 119), (9, 3), (200, 119)):
        found = series.dilations(length, n)
        assert sum(c for _, c in found) == n
        assert all(8 * d < length for d, _ in found)
    assert np.ptp(series.unflattened(np.ones((1, 20)))) == pytest.approx(1e-6)
    with pytest.raises(ValueError):
        series.dilations(8, 3)


def test_series_classifier_tells_shapes_apart(session):
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, (np.sin(np.arange(20) * (0.5 if i % 2 else 1.5) + rng.random() * 6) + rng.normal(size=20) * 0.2).tolist()) for i in range(60)]
    df = session.createDataFrame(rows, "id int, y int, s array<double>")
    model = series.fit(df.where("id < 40"), "y", "s", "id", 84 * 3)
    out = model.predicted(df.where("id >= 40"), "s").select("y", "prob").collect()
    assert np.mean([(r.prob >= 0.5) == r.y for r in out]) >= 0.9


@pytest.mark.parametrize("task_bytes", [series.TASK_BYTES, 0])
def test_series_fit_keeps_counts_of_a_byte(session, monkeypatch, task_bytes):
    """Fitted in one task or by passes over blocks, the slopes at the end are 0, and Spark caches no features."""
    monkeypatch.setattr(series, "BLOCK_SERIES", 16)
    monkeypatch.setattr(series, "TOLERANCE", 0.0)
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(90, 20)), (np.arange(90) % 3 == 0).astype(int)
    x[y == 1] += np.linspace(0, 1, 20)
    df = session.createDataFrame([(i, int(t), r.tolist()) for i, (t, r) in enumerate(zip(y, x, strict=True))], "id int, y int, s array<double>").repartition(3)
    model = series.fit(df, "y", "s", "id", 84 * 2, c=0.1, task_bytes=task_bytes)
    f, counts = model.convolutions.transform(x), model.convolutions.counts(x)
    assert counts.dtype == np.uint8 and np.allclose(counts / model.convolutions.places(20), f)
    scaled = (f - f.mean(0)) / np.where(f.std(0) > 0, f.std(0), 1.0)
    prob = 1 / (1 + np.exp(-(scaled @ model.weights + model.intercept)))
    rest = np.where(y == 1, 1.5, 0.75) * (prob - y) / 90
    assert abs(rest.sum()) < 1e-4 and np.allclose(rest @ scaled + model.weights / 9, 0, atol=1e-4)
    assert np.allclose([r.prob for r in model.predicted(df, "s").orderBy("id").collect()], prob)


def test_features_leave_in_small_batches(session, monkeypatch):
    rng = np.random.default_rng(21)
    rows = [(i, None if i % 7 == 3 else rng.normal(size=20).tolist()) for i in range(40)]
    df = session.createDataFrame(rows, "id int, s array<double>").coalesce(1)
    model = series.Convolutions.fit(rng.normal(size=(8, 20)), 84 * 2)
    plain = series.Convolutions.transform
    monkeypatch.setattr(series, "SERIES_ROWS", 6)

    def few(self, x):
        assert len(x) <= 6
        return plain(self, x)

    monkeypatch.setattr(series.Convolutions, "transform", few)
    out = {r.id: r.f for r in series.with_features(df, model, "s", "f", np.zeros(168), np.full(168, 2.0)).collect()}
    assert all((out[i] is None) == (v is None) for i, v in rows)
    known = [(i, v) for i, v in rows if v is not None]
    assert np.allclose([out[i] for i, _ in known], plain(model, np.array([v for _, v in known])) / 2)


def test_weights_of_classes_move_no_rows(session):
    df = session.range(0, 100, 1, 5).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    weighted = models.balanced_weights(df, "y")
    assert "SortMergeJoin" not in weighted._jdf.queryExecution().executedPlan().toString() and "BroadcastHashJoin" in weighted._jdf.queryExecution().executedPlan().toString()
    assert {(r.y, round(r.weight, 9)) for r in weighted.collect()} == {(1, 2.0), (0, round(100 / 150, 9))}


# Ridge ---------------------------------------------------------------------------------------------------------------


def test_ridge_equals_numpy(session):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(50, 4)), rng.normal(size=(50, 3))
    rows = [(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [(99, None, [0.0] * 3)]
    df = session.createDataFrame(rows, "id int, x array<double>, y array<double>").repartition(3)
    model = gram.ridge(df, "x", "y", 10.0)
    xc, yc = x - x.mean(0), y - y.mean(0)
    weights = np.linalg.solve(xc.T @ xc + 10 * np.eye(4), xc.T @ yc)
    assert np.allclose(model.weights, weights)
    out = {r.id: r.r for r in df.select("id", gram.residual(model, "x", "y").alias("r")).collect()}
    assert out.pop(99) is None
    assert np.allclose([out[i] for i in range(50)], yc - xc @ weights)
    with pytest.raises(ValueError):
        gram.ridge(df.where("id < 0"), "x", "y")


def test_sparse_ridge_equals_ridge(session):
    rng = np.random.default_rng(21)
    x = rng.integers(0, 3, (200, 30)) * (rng.random((200, 30)) < 0.15)
    x[:, 29] = 0
    x[7] = 0
    y = rng.normal(size=(200, 11))
    rows = [(k, a.astype(float).tolist(), np.flatnonzero(a).tolist(), a[a != 0].astype(float).tolist(), b.tolist()) for k, (a, b) in enumerate(zip(x, y, strict=True))] + [(999, None, None, None, [0.0] * 11)]
    df = session.createDataFrame(rows, "id int, x array<double>, i array<int>, v array<double>, y array<double>").repartition(3)
    model, want = gram.sparse_ridge(df, "i", "v", "y", 30, 10.0), gram.ridge(df, "x", "y", 10.0)
    assert np.allclose(model.weights, want.weights) and np.allclose(model.intercept, want.intercept)
    both = df.select("id", gram.sparse_residual(model, "i", "v", "y").alias("a"), gram.residual(want, "x", "y").alias("b")).collect()
    assert all(r.a is None and r.b is None if r.id == 999 else np.allclose(r.a, r.b) for r in both)
    with pytest.raises(ValueError):
        gram.sparse_ridge(df.where("id < 0"), "i", "v", "y", 30)


def test_sparse_ridge_of_many_inputs(session):
    # The square of 40,000 inputs would take 12.8 GB.
    rows = [(i, [i % 40_000, 39_999 - i % 7], [1.0, 2.0], [float(i % 5)]) for i in range(2_000)]
    df = session.createDataFrame(rows, "id int, i array<int>, v array<double>, y array<double>")
    model = gram.sparse_ridge(df, "i", "v", "y", 40_000, 10.0)
    assert model.weights.shape == (40_000, 1)
    rest = np.array([r.y[0] - model.intercept[0] - np.dot(r.v, model.weights[r.i, 0]) for r in df.collect()])
    assert abs(rest.sum()) < 1e-6
    for place in (0, 1999, 39_999):  # the gradient is 0
        at = [(k, v[i.index(place)]) for k, i, v, _ in rows if place in i]
        assert sum(v * rest[k] for k, v in at) == pytest.approx(10 * model.weights[place, 0], abs=1e-6)


def test_section_words_stay_sparse(session):
    from tracewell.plans import model_queries

    rows = session.createDataFrame([(1, "a bird sang here"), (2, "a bird flew"), (3, "")], "id int, section string")
    out = {r.id: r for r in model_queries.section_grams(rows)(rows).collect()}
    assert out[1].x.size == 1 and (out[1].i, out[1].v) == ([0], [1.0]) and (out[3].i, out[3].v) == ([], [])


# Out of fold and artifacts -------------------------------------------------------------------------------------------


def test_out_of_fold_artifacts(session, tmp_path):
    x, y = table(200, 7, 0.0)
    df = frame(session, x, y).withColumn("fold", (F.col("id") % 4).cast("int")).persist()
    for name, target in (("logreg", "y"), ("ridge", "a")):
        columns = COLUMNS if target == "y" else ["b", "c"]
        result = specs.run_oof(specs.SPECS[name], df, "id", target, columns)
        for run in range(2):  # a second run replaces the first
            specs.save(result, f"file://{tmp_path}", "run")
        back = specs.load(session, f"file://{tmp_path}", "run", name)
        rows = back.predictions.collect()
        assert sorted(r.id for r in rows) == list(range(200))
        assert all(r.fold == r.id % 4 for r in rows)
        assert sorted((r.fold, r.feature) for r in back.importance.collect()) == sorted((f, c) for f in range(4) for c in columns)
        assert all(r.importance == abs(r.signed) for r in back.importance.collect())
        means = {r.feature: r for r in specs.mean_importance(back).collect()}
        one = [r.importance for r in back.importance.where("feature = 'b'").collect()]
        assert (means["b"].mean, means["b"].std) == (pytest.approx(np.mean(one)), pytest.approx(np.std(one, ddof=1)))
        if name == "ridge":
            test = np.arange(200) % 4 == 0
            z = x[:, 1:]
            mean, scale = z[~test].mean(0), z[~test].std(0)
            z, t = (z - mean) / scale, x[:, 0]
            zc = z[~test] - z[~test].mean(0)
            w = np.linalg.solve(zc.T @ zc + np.eye(2), zc.T @ (t[~test] - t[~test].mean()))
            want = z[test] @ w + t[~test].mean()
            assert np.allclose([r.pred for r in sorted(rows, key=lambda r: r.id) if r.fold == 0], want)
    df.unpersist()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        specs.load(session, f"file://{tmp_path}", "other", "logreg")


# Weighted bootstrap --------------------------------------------------------------------------------------------------


def test_weights_are_poisson():
    w = resampling.weights(np.arange(300), 400)
    assert w.mean() == pytest.approx(1, abs=0.02)
    assert w.var() == pytest.approx(1, abs=0.05)
    assert (resampling.weights(np.array([7]), 400) == w[7]).all()


def test_weighted_interval_equals_plain_loops(session, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(g, i, int(rng.random() < 0.4), float(rng.integers(0, 12)) if rng.random() < 0.9 else None) for g in ("u", "v") for i in range(80)] + [("w", 1, 1, 0.5)]
    df = session.createDataFrame(rows, "g string, i bigint, y int, s double")
    monkeypatch.setattr(resampling, "RANGE_ROWS", 30)  # several ranges
    out = {r.g: r for r in resampling.weighted_auc_interval(df, "y", "s", "i", ["g"], 50).collect()}
    for g in ("u", "v"):
        own = [(i, y, s) for h, i, y, s in rows if h == g and s is not None]
        w = resampling.weights(np.array([i for i, _, _ in own]), 50)
        aucs = []
        for b in range(50):
            won = sum(w[p, b] * w[q, b] * (1.0 if own[p][2] > own[q][2] else 0.5 if own[p][2] == own[q][2] else 0.0) for p in range(len(own)) for q in range(len(own)) if own[p][1] == 1 and own[q][1] == 0)
            pos, neg = sum(w[p, b] for p in range(len(own)) if own[p][1] == 1), sum(w[p, b] for p in range(len(own)) if own[p][1] == 0)
            if pos and neg:
                aucs.append(won / (pos * neg))
        r = out[g]
        assert (r.resamples, r.low, r.high) == (len(aucs), pytest.approx(np.quantile(aucs, 0.025)), pytest.approx(np.quantile(aucs, 0.975)))
    assert (out["w"].resamples, out["w"].low) == (0, None)


def test_weights_of_one_score_are_held_in_parts(session, monkeypatch):
    """Rows of one score are weighted some at a time, however many there are, and the result is that of all at once."""
    rows = [(i, i % 3 % 2, float(i % 2)) for i in range(400)]
    df = session.createDataFrame(rows, "i bigint, y int, s double").coalesce(1)
    monkeypatch.setattr(resampling, "WEIGHED_ROWS", 1000)
    whole = resampling.weighted_auc_interval(df.select(F.lit("g").alias("g"), "*"), "y", "s", "i", ["g"], 50).first()
    plain = resampling.weights

    def few(rows, resamples, seed=42):
        assert len(rows) <= 7
        return plain(rows, resamples, seed)

    monkeypatch.setattr(resampling, "WEIGHED_ROWS", 7)
    monkeypatch.setattr(resampling, "weights", few)
    assert resampling.weighted_auc_interval(df.select(F.lit("g").alias("g"), "*"), "y", "s", "i", ["g"], 50).first() == whole


def test_mean_interval_reads_rows_in_many_tasks(session):
    """Only the tasks' sums meet in one task, not the rows."""
    df = session.range(0, 100, 1, 5).select("id", F.col("id").cast("double").alias("v"))
    plan = resampling.weighted_mean_interval(df, "v", "id", 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition 1, true" in plan and "Repartition 1, false" not in plan


def test_verdicts(session):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(120):
        target = int(rng.random() < 0.5)
        noise = float(rng.normal())
        for name, score in (("for", noise - 2 * target), ("against", noise + 2 * target), ("neither", noise), ("few", noise if i < 10 else None)):
            rows.append((i, target, name, score, score is not None and score > 1))
    df = session.createDataFrame(rows, "k bigint, target int, detector string, score double, flag boolean")
    out = {r.detector: r for r in detectors.verdicts(df, "k", "target", 200).collect()}
    assert {d: r.verdict for d, r in out.items()} == {"for": "confirmed", "against": "inverted", "neither": "inconclusive", "few": "insufficient_data"}
    assert out["for"].ci_low < out["for"].auc < out["for"].ci_high
    assert out["for"].precision is not None
    assert out["against"].precision is None
    assert out["few"].ci_low is None


# Failure types, categories -------------------------------------------------------------------------------------------


def test_failure_types(session):
    rng = np.random.default_rng(10)
    rows = [(i, ["x", "y", "z"][i % 3], float(i % 3) + rng.normal() * 0.2, float(rng.normal())) for i in range(90)]
    rows += [(200, "rare", 0.0, 0.0), (201, None, 0.0, 0.0), (202, " none ", 0.0, 0.0)]
    df = session.createDataFrame(rows, "id int, kind string, a double, b double")
    out = attribution.failure_types(df, "id", "kind", ["a", "b"])
    s = out.summary.first()
    assert (s.skipped, s.n_items, s.n_classes, s.folds) == (False, 90, 3, 5)
    assert s.macro_auc > 0.95
    got = out.rows.collect()
    assert len(got) == 90
    for r in got:
        assert sum(r.probs.values()) == pytest.approx(1)
        assert r.pred_type == max(r.probs, key=r.probs.get)
    assert s.accuracy == pytest.approx(np.mean([r.correct for r in got]))
    assert "fewer than two types" in attribution.failure_types(df.where("kind = 'x'"), "id", "kind", ["a"]).summary.first().reason
    assert "no row" in attribution.failure_types(df.where("kind is null"), "id", "kind", ["a"]).summary.first().reason


def test_one_hot(session):
    df = session.createDataFrame([("b",), ("a",), (None,), ("c",)], "k string")
    out, names = labeling.one_hot(df, "k", drop_first=True)
    assert names == ["k_b", "k_c"]
    assert sorted(map(tuple, out.collect()), key=str) == [("a", 0.0, 0.0), ("b", 1.0, 0.0), ("c", 0.0, 1.0), (None, 0.0, 0.0)]
    with pytest.raises(ValueError):
        labeling.one_hot(out, "k")


# Archives ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_archive_source(session, tmp_path, save):
    n = 23
    save(tmp_path / "one.npz", e=np.arange(n * 3, dtype=np.float32).reshape(n, 3), name=np.array([f"é{i}" for i in range(n)]), k=np.arange(n), ok=np.arange(n) % 2 == 0)
    df = archives.read_arrays(session, str(tmp_path / "one.npz"), 7)
    assert dict(df.dtypes) == {"e": "array<float>", "name": "string", "k": "bigint", "ok": "boolean"}
    assert df.rdd.getNumPartitions() == 4
    rows = df.orderBy("k").collect()
    assert [tuple(r.e) for r in rows] == [(3.0 * i, 3.0 * i + 1, 3.0 * i + 2) for i in range(n)]
    assert [(r.name, r.ok) for r in rows] == [(f"é{i}", i % 2 == 0) for i in range(n)]
    assert df.select("k").where("k > 20").count() == 2


def test_archive_round_trip(session, tmp_path):
    df = session.createDataFrame([(i, [float(i), 0.5], f"t{i}") for i in range(30)], "i bigint, v array<double>, t string").repartition(3)
    for _ in range(2):  # overwritten, not added to
        archives.write_arrays(df, str(tmp_path / "out"))
    back = archives.read_arrays(session, str(tmp_path / "out"), 4)
    assert sorted((r.i, tuple(r.v), r.t) for r in back.collect()) == [(i, (float(i), 0.5), f"t{i}") for i in range(30)]
    ragged = session.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "i int, v array<double>").coalesce(1)
    with pytest.raises(Exception, match="different lengths"):
        archives.write_arrays(ragged, str(tmp_path / "bad"))
    with pytest.raises(Exception, match="no archive"):
        archives.read_arrays(session, str(tmp_path))


# Linear models and thresholded joins ---------------------------------------------------------------------------------


def test_least_squares_equals_numpy(session):
    from tracewell.operators import models

    rng = np.random.default_rng(11)
    x = rng.normal(size=(40, 2))
    y = 2 + x @ [1.5, -0.5] + rng.normal(size=40) * 0.1
    df = session.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(x, y, strict=True)] + [(None, 1.0, 1.0)], "a double, b double, y double")
    out = {r.term: r for r in models.least_squares(df, "y", ["a", "b"]).collect()}
    design = np.column_stack([np.ones(40), x])
    want, rest, *_ = np.linalg.lstsq(design, y, rcond=None)
    assert [out[t].coefficient for t in ("intercept", "a", "b")] == pytest.approx(want.tolist())
    assert out["a"].r2 == pytest.approx(1 - rest[0] / ((y - y.mean()) ** 2).sum())
    assert out["a"].n == 40


def test_svm_tells_classes_apart(session):
    from pyspark.ml.functions import array_to_vector

    from tracewell.operators import models

    rng = np.random.default_rng(12)
    rows = [(i % 3, (rng.normal(size=2) * 0.3 + [[0, 2], [2, 0], [-2, -2]][i % 3]).tolist()) for i in range(90)]
    df = session.createDataFrame(rows, "y int, v array<double>").withColumn("features", array_to_vector("v"))
    out = models.linear_svm(df, "y", c=10.0).transform(df).select("y", "prediction").collect()
    assert np.mean([r.y == r.prediction for r in out]) > 0.95


@pytest.mark.parametrize("least", [0.2, 0.5, 0.8, 1.0])
def test_thresholded_overlap_equals_all_pairs(session, least):
    from tracewell.operators import retrieval

    rng = np.random.default_rng(13)
    text = lambda: [f"w{int(w)}" for w in np.minimum(rng.zipf(1.5, rng.integers(1, 12)), 30)]
    left = [(i % 2, i, text()) for i in range(60)]
    right = [(i % 2, i, left[i][2][: rng.integers(1, 12)] if i % 3 else text()) for i in range(40)]
    tokens = lambda rows, key: retrieval.token_counts(session.createDataFrame(rows, f"g int, {key} int, t array<string>"), ["g", key], F.col("t"))
    a, b = tokens(left, "l"), tokens(right, "r")
    whole = retrieval.overlap_f1(a, b, "g", "l", "r")
    key = lambda df: sorted((r.g, r.l, r.r, r.overlap, round(r.f1, 9)) for r in df.collect())
    assert key(retrieval.overlap_f1_at_least(a, b, "g", "l", "r", least)) == key(whole.where(F.col("f1") >= least))
    if least >= 0.5:
        assert retrieval.likely_pairs(a, b, "g", "l", "r", least).count() < whole.count()


def test_mixed_numbers_agree(session):
    rows = session.range(50).select(resampling.mixed_column(F.col("id"), F.lit(7)).alias("x")).collect()
    assert [r.x for r in rows] == resampling.mixed(np.arange(50), np.array(7)).tolist()


def test_weighted_mean_interval_equals_numpy(session):
    rng = np.random.default_rng(14)
    v = rng.normal(size=70)
    df = session.createDataFrame([(i, float(x)) for i, x in enumerate(v)] + [(70, None)], "i bigint, v double").repartition(3)
    r = resampling.weighted_mean_interval(df, "v", "i", 200).first()
    w = resampling.weights(np.arange(70), 200)
    x = (v @ w) / w.sum(0)
    assert (r.resamples, r.mean, r.low, r.high, r.p_one_tailed) == (200, pytest.approx(x.mean()), pytest.approx(np.quantile(x, 0.025)), pytest.approx(np.quantile(x, 0.975)), pytest.approx((x <= 0).mean()))
    assert resampling.weighted_mean_interval(df.where("i < 0"), "v", "i", 10).first().mean is None


def exchanges(df):
    """Keys of the shuffles of a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)]


def test_tokens_of_passages_are_not_shuffled(session):
    left = session.createDataFrame([(0, 1, "a b c"), (0, 2, "a a d"), (1, 3, "b")], "g int, l int, text string")
    right = session.createDataFrame([(0, 7, "a b"), (1, 8, "b b")], "g int, r int, text string")
    tokens = lambda df, key: retrieval.token_counts(df, ["g", key], F.split("text", " "))
    found = retrieval.overlap_f1_at_least(tokens(left, "l"), tokens(right, "r"), "g", "l", "r", 0.5)
    assert {(r.l, r.r): r.f1 for r in found.collect()} == {(1, 7): pytest.approx(0.8), (3, 8): pytest.approx(2 / 3)}
    assert {k for k in exchanges(found) if "l" in k.split(", ")} == {"g, l"}
    whole = retrieval.overlap_f1(tokens(left, "l"), tokens(right, "r"), "g", "l", "r")
    assert {k for k in exchanges(whole) if "l" in k.split(", ")} == {"g, l"}


def test_terms_of_documents_are_not_shuffled_for_bm25(session):
    documents = session.createDataFrame([(0, 1, "a b c"), (0, 2, "a a d"), (1, 3, "b"), (None, 4, "a")], "g int, doc_id int, text string")
    queries = session.createDataFrame([(0, 7, "a b"), (1, 8, "b b")], "g int, query_id int, text string")
    found = retrieval.bm25(documents, queries, "g")
    assert {(r.query_id, r.doc_id) for r in found.collect()} == {(7, 1), (7, 2), (8, 3)}
    assert {k for k in exchanges(found) if "doc_id" in k.split(", ")} == {"g, doc_id"}
