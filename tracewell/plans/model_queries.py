"""Queries over fitted models: verdicts of detectors, out-of-fold results with importances, series, residuals and failure types."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizer, NGram, RegexTokenizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import attribution, gram, resampling, series, specs
from ..operators import detectors as D
from ..operators import labeling as L
from ..operators import models as M
from ..operators import sampling as P
from ..operators import statistics as S
from ..sources import archives, load_table, scratch, stored
from .attempt_queries import _COLUMNS, _DET, doc_features, flagged
from .registry import query
from .text_queries import DOCS, labelled
from .trace_queries import rounded, traces_of_values

_W = f"""u AS (SELECT DISTINCT user_id AS i FROM fl), wt AS (SELECT i, b, {resampling.weight_sql()} AS w FROM u, range({D.RESAMPLES}) r(b)),
cl AS (SELECT detector, b, score, sum(w) FILTER (WHERE target = 0) AS p, sum(w) FILTER (WHERE target = 1) AS q FROM fl JOIN wt ON i = user_id GROUP BY ALL),
cu AS (SELECT detector, b, coalesce(p, 0) AS p, coalesce(q, 0) AS q, coalesce(sum(q) OVER (PARTITION BY detector, b ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM cl),
au AS (SELECT detector, b, sum(p * (below + q / 2)) / (sum(p) * sum(q)) AS x FROM cu GROUP BY ALL HAVING sum(p) > 0 AND sum(q) > 0),
ci AS (SELECT detector, count(*) AS resamples, quantile_cont(x, 0.025) AS low, quantile_cont(x, 0.975) AS high FROM au GROUP BY detector),
rk AS (SELECT detector, 1 - target AS failed, flag, rank() OVER (PARTITION BY detector ORDER BY score) + (count(*) OVER (PARTITION BY detector, score) - 1) / 2.0::DOUBLE AS r FROM fl),
s AS (SELECT detector, count(*) AS n, sum(failed) AS p, sum(r) FILTER (WHERE failed = 1) AS sr, count(*) FILTER (WHERE flag) AS flagged, count(*) FILTER (WHERE flag AND failed = 1) AS hits FROM rk GROUP BY detector),
e AS (SELECT detector, n, flagged, p / n AS base, CASE WHEN p > 0 AND p < n THEN (sr - p * (p + 1) / 2) / (p * (n - p)) END AS auc, CASE WHEN flagged > 0 THEN hits / flagged END AS prec, CASE WHEN p > 0 THEN hits / p END AS rec FROM s),
v AS (SELECT e.*, CASE WHEN n >= {D.LEAST_ROWS} AND auc IS NOT NULL AND resamples >= {D.RESAMPLES // 4} THEN low END AS low, CASE WHEN n >= {D.LEAST_ROWS} AND auc IS NOT NULL AND resamples >= {D.RESAMPLES // 4} THEN high END AS high FROM e LEFT JOIN ci USING (detector)),
vv AS (SELECT *, CASE WHEN low IS NULL THEN 'insufficient_data' WHEN low > 0.5 THEN 'confirmed' WHEN high < 0.5 THEN 'inverted' ELSE 'inconclusive' END AS verdict FROM v)"""


@query(
    "q_detector_verdicts",
    f"{_DET}, {_W} SELECT detector, n, flagged, round(base, 6) AS base, round(auc, 6) AS auc, round(low, 6) AS ci_low, round(high, 6) AS ci_high, verdict, round(CASE WHEN verdict = 'confirmed' AND flagged > 0 THEN prec END, 6) AS precision, round(CASE WHEN verdict = 'confirmed' AND flagged > 0 THEN rec END, 6) AS recall, round(CASE WHEN verdict = 'confirmed' AND flagged > 0 THEN CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END END, 6) AS f1, round(CASE WHEN verdict = 'confirmed' AND flagged > 0 THEN prec / base END, 6) AS lift FROM vv",
)
def detector_verdicts(spark, sf):
    """Every detector's hypothesis with a bootstrapped interval of 1,000 resamples."""
    return rounded(D.verdicts(flagged(spark, sf), "user_id", "target"))


_RESAMPLED = lambda rows: f"WITH v AS ({rows}), wt AS (SELECT i, b, {resampling.weight_sql()} AS w FROM (SELECT DISTINCT i FROM v), range(1000) r(b))"
_CI = "count(x) AS resamples, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high"


@query("q_mean_interval", f"{_RESAMPLED(f'SELECT doc_id AS i, quality - (words >= 100)::INT AS v FROM ({DOCS}) JOIN labels USING (doc_id)')}, m AS (SELECT b, sum(w * v) / sum(w) AS x FROM v JOIN wt USING (i) GROUP BY b HAVING sum(w) > 0) SELECT {_CI}, round(avg((x <= 0)::INT), 6) AS p_one_tailed FROM m")
def mean_interval(spark, sf):
    """Mean of the paired differences of two 0/1 columns in 1,000 resamples."""
    rows = labelled(spark, sf).select("doc_id", (F.col("quality") - (F.col("words") >= 100).cast("int")).cast("double").alias("difference"))
    return rounded(resampling.weighted_mean_interval(rows, "difference", "doc_id"))


@query(
    "q_auc_interval",
    f"{_RESAMPLED(f'SELECT lang, doc_id AS i, quality AS y, words::DOUBLE AS s FROM ({DOCS}) JOIN labels USING (doc_id)')}, c AS (SELECT lang, b, s, coalesce(sum(w) FILTER (WHERE y = 1), 0) AS p, coalesce(sum(w) FILTER (WHERE y = 0), 0) AS q FROM v JOIN wt USING (i) GROUP BY ALL), k AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY lang, b ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c), m AS (SELECT lang, b, sum(p * (below + q / 2)) / (sum(p) * sum(q)) AS x FROM k GROUP BY ALL HAVING sum(p) > 0 AND sum(q) > 0) SELECT lang, {_CI} FROM m GROUP BY lang",
)
def auc_interval(spark, sf):
    """AUC of the length for quality per language, in 1,000 resamples; a language without a resample of both classes has no row."""
    rows = labelled(spark, sf).select("lang", "doc_id", "quality", F.col("words").cast("double").alias("words"))
    return rounded(resampling.weighted_auc_interval(rows, "quality", "words", "doc_id", ["lang"]).where("resamples > 0"))


# Models: documents' quality from their surface features, and their length in words from the other features.
def _folds(df: DataFrame, label: str, key: str) -> DataFrame:
    return P.stratified_folds(df, label, key, order=[F.col(key)])


def quality_rows(spark, sf) -> DataFrame:
    return stored(_folds(doc_features(spark, sf), "quality", "doc_id"), "quality_rows")


def length_rows(spark, sf) -> DataFrame:
    rows = doc_features(spark, sf).withColumn("log_words", F.log(F.col("words") + 1))
    return stored(_folds(rows, "quality", "doc_id"), "length_rows")


def _metrics(result: specs.Result) -> DataFrame:
    return rounded(result.metrics.withColumn("model", F.lit(result.name)))


@query("q_boosted_leafwise")
def boosted_leafwise(spark, sf):
    """300 trees of 31 leaves, out of fold: metrics of each fold."""
    return _metrics(specs.run_oof(specs.SPECS["boosted"], quality_rows(spark, sf), "doc_id", "quality", _COLUMNS))


@query("q_boosted_with_subject")
def boosted_with_subject(spark, sf):
    """The same with the language as columns of 0 and 1, and with gaps: shares of short texts count as missing."""
    rows = doc_features(spark, sf).join(load_table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    rows = rows.withColumn("distinct_share", F.when(F.col("words") >= 50, F.col("distinct_share")))
    wide, extra = L.one_hot(rows, "lang")
    return _metrics(specs.run_oof(specs.SPECS["boosted_gaps"], stored(_folds(wide, "quality", "doc_id"), "subject_rows"), "doc_id", "quality", [*_COLUMNS, *extra]))


@query("q_regressors")
def regressors(spark, sf):
    """Ridge and boosted regression of the logarithm of the words."""
    rows = length_rows(spark, sf)
    out = [_metrics(specs.run_oof(specs.SPECS[name], rows, "doc_id", "log_words", _COLUMNS)) for name in ("ridge", "boosted_reg")]
    return out[0].unionByName(out[1])


@query("q_model_importance")
def model_importance(spark, sf):
    """Importances of the models of all folds, from the artifacts of a run: their mean and deviation, strongest first."""
    rows, folder = quality_rows(spark, sf), scratch(spark, "artifacts")
    out = None
    for name in ("logreg", "boosted"):
        specs.save(specs.run_oof(specs.SPECS[name], rows, "doc_id", "quality", _COLUMNS), folder, "run")
        one = specs.mean_importance(specs.load(spark, folder, "run", name)).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    place = F.row_number().over(Window.partitionBy("model").orderBy(F.col("mean").desc(), "feature"))  # a row per feature
    return rounded(out.withColumn("place", place))


@query("q_oof_artifacts", "SELECT doc_id AS id, ((row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % 5)::INT AS fold, quality::DOUBLE AS target FROM labels JOIN documents USING (doc_id)")
def oof_artifacts(spark, sf):
    """The predictions of a run as they are read back: each labelled row once, in its fold."""
    folder = scratch(spark, "artifacts")
    specs.save(specs.run_oof(specs.SPECS["logreg"], quality_rows(spark, sf), "doc_id", "quality", _COLUMNS), folder, "run")
    return specs.load(spark, folder, "run", "logreg").predictions.where("pred between 0 and 1").select("id", "fold", "target")


# Traces of users: success is a share of purchases above a fifth.
def trace_series(spark, sf) -> DataFrame:
    outcome = load_table(spark, sf, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") == "purchase") > F.count("*") / 5).cast("int").alias("target"))
    rows = traces_of_values(spark, sf).select("user_id", *(F.get("xs", F.lit(i)).alias(f"t{i:02d}") for i in range(20)))
    return stored(_folds(rows.join(outcome, "user_id"), "target", "user_id"), "trace_series")


@query("q_series_classifier")
def series_classifier(spark, sf):
    """AUC of the convolution features of the traces, fold by fold: as many folds at a time as their counts, 10 KB a trace, may take up."""
    rows = trace_series(spark, sf)
    at_once = max(1, min(5, series.HELD // max(1, rows.count() * series.FEATURES)))
    return _metrics(specs.run_oof(specs.SPECS["convolutions"], rows, "user_id", "target", [f"t{i:02d}" for i in range(20)], at_once=at_once))


@query("q_series_features", "SELECT user_id, true AS shares, 9996 AS n FROM events GROUP BY user_id")
def series_features(spark, sf):
    """The convolution features of all traces: their number, and whether all are shares."""
    rows = trace_series(spark, sf).select("user_id", F.array(*(f"t{i:02d}" for i in range(20))).alias("series"))
    examples = [r[0] for r in rows.orderBy("user_id").limit(series.EXAMPLES).select("series").collect()]
    import numpy as np

    convolutions = series.Convolutions.fit(np.array(examples))
    out = series.with_features(rows, convolutions, "series", "f")
    return out.select("user_id", F.forall("f", lambda x: (x >= 0) & (x <= 1)).alias("shares"), F.size("f").alias("n"))


@query("q_failure_types")
def failure_types(spark, sf):
    """The kind of event that a trace ends with, from its shape: metrics out of fold."""
    last = load_table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))
    traces = stored(traces_of_values(spark, sf).select("user_id", "xs"), "traces")
    shapes = V.trajectory_features(F.col("xs"), "reasoning")
    names = [f"reasoning_{n}" for n in ("end", "std", "range", "monotonicity", "direction_changes", "fall_from_peak", "max_rise")]
    rows = stored(traces.select("user_id", *(shapes[n].cast("double").alias(n) for n in names)).join(last, "user_id"), "typed_traces")
    return rounded(attribution.failure_types(rows, "user_id", "last_type", names).summary)


# Sections: a vector's section is named by the first words of the document of its number.
def section_vectors(spark, sf) -> DataFrame:
    names = load_table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), r"\s+"), 1, 4), " ").alias("section"))
    vectors = load_table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), (F.col("label") % 3).alias("lvl"))
    return P.group_split(vectors.join(names, "vec_id"), "vec_id", [("train", 0.6), ("validation", 0.2), ("test", 0.2)])


def section_grams(train: DataFrame, least: int = 2):
    """A function that adds counts of one and two successive words of the section (of two letters at least), as vector x.

    The vocabulary has what occurs in ``least`` training rows or more, all of it, and grows with the rows; a row has few
    of its words, whose places and counts are in the arrays i and v too.
    """
    words = RegexTokenizer(inputCol="section", outputCol="__words", pattern=r"(?U)\w\w+", gaps=False)
    pairs = NGram(n=2, inputCol="__words", outputCol="__pairs")
    grams = lambda df: pairs.transform(words.transform(df)).withColumn("__grams", F.concat("__words", "__pairs"))
    model = CountVectorizer(inputCol="__grams", outputCol="x", minDF=least, vocabSize=2**31 - 1).fit(grams(train))
    entries = F.udf(lambda x: (x.indices.tolist(), x.values.tolist()), "i array<bigint>, v array<double>")
    return lambda df: model.transform(grams(df)).withColumn("__x", entries("x")).select("*", "__x.i", "__x.v").drop("__words", "__pairs", "__grams", "__x")


def _scaled(train: DataFrame, column: str):
    """A function that scales an array column by the moments of the training rows."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    m = train.select(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(column)).alias("s")).select("s.*").first()
    n = m["count"]
    mean, deviation = m["mean"].toArray().tolist(), [(v * (n - 1) / n) ** 0.5 for v in m["variance"].toArray()]
    a, s = F.array(*map(F.lit, mean)), F.array(*(F.lit(d if d > 0 else 1.0) for d in deviation))
    return lambda df: df.withColumn(column, F.zip_with(F.zip_with(column, a, lambda x, y: x - y), s, lambda x, y: x / y))


def _probe(name: str, rows: DataFrame, column: str, cs: tuple[float, ...], fit=None) -> DataFrame:
    """Macro-F1 on the test rows of the C that does best on the validation rows."""
    part = lambda split: rows.where(F.col("split") == split)
    train, valid, test = part("train"), part("validation"), part("test")
    out, best = M.swept_probe(train, valid, test, "lvl", column, cs, fit)
    scores = S.averaged_metrics(S.class_metrics(out.select("lvl", F.col("prediction").cast("int").alias("p")), "lvl", "p"))
    return scores.select(F.lit(name).alias("probe"), F.lit(best).alias("c"), "macro_f1")


@query("q_section_residual_probe")
def section_residual_probe(spark, sf):
    """Levels from section names alone, from vectors, and from what section names don't explain of the vectors."""
    rows = stored(section_vectors(spark, sf), "sections")
    add = section_grams(rows.where("split = 'train'"))
    scale = _scaled(rows.where("split = 'train'"), "e")
    rows = stored(add(scale(rows)), "section_grams")
    size = rows.select("x").first()["x"].size
    model = gram.sparse_ridge(rows.where("split = 'train'"), "i", "v", "e", size, 10.0)
    rest = stored(rows.withColumn("e", gram.sparse_residual(model, "i", "v", "e")), "residuals")
    rest = _scaled(rest.where("split = 'train'"), "e")(rest)
    out = _probe("section", rows, "x", (1.0,)).unionByName(_probe("full", rows, "e", (10.0,))).unionByName(_probe("residual", rest, "e", (0.01, 0.1, 1.0, 10.0)))
    return rounded(out)


# Probes and baselines
@query("q_linear_probes")
def linear_probes(spark, sf):
    """Logistic and support-vector probes, each with the C that does best on validation rows; the split is by group of vectors."""
    v = load_table(spark, sf, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 4).alias("group"), F.col("embedding").cast("array<double>").alias("e"), (F.col("label") % 3).alias("lvl"))
    rows = stored(P.group_split(v, "group", [("train", 0.6), ("validation", 0.2), ("test", 0.2)]), "probe_rows")
    out = None
    for kind, fit in M.LINEAR_PROBES.items():
        one = _probe(kind, rows, "e", (0.01, 0.1, 1.0, 10.0), lambda d, c, fit=fit: fit(d, "lvl", c))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


_MIXED = resampling.mixed_sql("vec_id", "7")


@query("q_random_baseline", f"WITH g AS (SELECT label % 3 AS t, ({_MIXED}) % 3 AS p FROM embeddings), c AS (SELECT k, count(*) FILTER (WHERE t = k AND p = k) AS hit, count(*) FILTER (WHERE t = k) AS pos, count(*) FILTER (WHERE p = k) AS guess FROM g, range(3) r(k) GROUP BY k) SELECT (SELECT count(*) FROM g) AS n, round((SELECT avg((t = p)::INT) FROM g), 6) AS accuracy, round(avg(2 * hit / (pos + guess)), 6) AS macro_f1 FROM c WHERE pos + guess > 0")
def random_baseline(spark, sf):
    """Classes guessed evenly at random, by the vector's number."""
    rows = load_table(spark, sf, "embeddings").select((F.col("label") % 3).cast("int").alias("t"), (resampling.mixed_column(F.col("vec_id"), F.lit(7)) % 3).cast("int").alias("p"))
    scores = S.averaged_metrics(S.class_metrics(rows, "t", "p")).select("macro_f1")
    return rounded(rows.agg(F.count("*").alias("n"), F.avg((F.col("t") == F.col("p")).cast("double")).alias("accuracy")).crossJoin(scores))


@query("q_probe_baselines")
def probe_baselines(spark, sf):
    """Macro-F1 of probes on the length of the vector's document alone, and on random vectors of the same size."""
    words = F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")).cast("double")
    names = load_table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.array(words).alias("length"))
    noise = lambda i: (resampling.mixed_column(F.col("vec_id"), i) / resampling.MODULUS) * 2 - 1
    v = load_table(spark, sf, "embeddings").select("vec_id", (F.col("label") % 3).alias("lvl"), F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: noise(i.cast("bigint"))).alias("random"))
    rows = stored(P.group_split(v.join(names, "vec_id"), "vec_id", [("train", 0.6), ("validation", 0.2), ("test", 0.2)]), "baseline_rows")
    rows = _scaled(rows.where("split = 'train'"), "length")(rows)
    return rounded(_probe("length", rows, "length", (1.0,)).unionByName(_probe("random_vector", rows, "random", (1.0,))))


@query("q_ols_dummies")
def ols_dummies(spark, sf):
    """Words of a document by its share of different words, its markup and its language, of which the first is the reference."""
    rows = doc_features(spark, sf).join(load_table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    wide, extra = L.one_hot(rows, "lang", drop_first=True)
    return rounded(M.least_squares(wide, "words", ["distinct_share", "bars", *extra]))


@query("q_held_out_ablation")
def held_out_ablation(spark, sf):
    """Out-of-fold AUC of each group of features; if all together are below 0.65, that of boosted trees is added as the fallback."""
    rows = quality_rows(spark, sf)
    groups = {"surface": ["entity_density", "exclaims", "bars"], "diversity": ["distinct_share"], "length": ["words"], "all": [*_COLUMNS, "words"]}
    auc_of = lambda model, columns: S.auc(specs.run_oof(specs.SPECS[model], rows, "doc_id", "quality", columns).predictions, "target", "pred").first()["auc"]
    found = [(name, "logreg", auc_of("logreg", columns)) for name, columns in groups.items()]
    if found[-1][2] < 0.65:
        found.append(("all", "boosted", auc_of("boosted", groups["all"])))
    return rounded(spark.createDataFrame(found, "features string, model string, auc double"))


@query("q_category_auc")
def category_auc(spark, sf):
    """Macro one-vs-rest AUC of the languages from what should tell them apart and from what would leak them: length, and where a text comes from."""
    rows = doc_features(spark, sf).join(load_table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")
    rows = stored(rows.withColumn("place", F.regexp_extract("source", r"\d+", 0).cast("double")), "category_rows")
    out = None
    for name, columns in {"shape": _COLUMNS, "length": ["words"], "source": ["place"]}.items():
        one = attribution.failure_types(rows, "doc_id", "lang", columns).summary.select(F.lit(name).alias("features"), "skipped", "n_items", "n_classes", "accuracy", "macro_f1", "macro_auc")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


# Archives
@query("q_array_archive", "WITH q AS (SELECT DISTINCT label FROM embeddings WHERE vec_id % 100 = 0) SELECT vec_id, label, round(list_sum(embedding::DOUBLE[]), 6) + 0.0 AS total, len(embedding)::INT AS width FROM embeddings JOIN q USING (label)")
def array_archive(spark, sf):
    """Vectors written as archives of arrays and read back, then looked up by the labels of the query vectors."""
    path = scratch(spark, "archives")
    vectors = load_table(spark, sf, "embeddings")
    archives.write_arrays(vectors, path)
    back = archives.read_arrays(spark, path, 1000)
    asked = vectors.where("vec_id % 100 = 0").select("label").distinct()
    found = archives.level_lookup(back, asked, "label")
    return rounded(found.select("vec_id", "label", F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x).alias("total"), F.size("embedding").alias("width")))
