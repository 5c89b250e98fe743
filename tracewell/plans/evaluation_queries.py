"""Queries that evaluate: trace assembly, coverage, samples, bootstraps, importance, axes by layer and model comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import attempts as A
from ..operators import axes
from ..operators import labeling as L
from ..operators import models as M
from ..operators import retrieval as R
from ..operators import sampling as P
from ..operators import shaping as H
from ..operators import statistics as S
from ..sources import load_table
from .attempt_queries import _ATT, _COLUMNS, attempts, doc_features
from .registry import query
from .retrieval_queries import _CAND, candidates
from .text_queries import DOCS, docs, labelled
from .trace_queries import JUMPS, jump_metrics, levelled_events, rounded


@query(
    "q_trace_assembly",
    f"WITH j AS ({JUMPS}), s AS (SELECT user_id, round(avg(value), 6) AS score FROM events WHERE event_type = 'purchase' GROUP BY user_id), m AS (SELECT user_id, jump_count FROM j WHERE jump_count > 30) SELECT user_id, count(*) AS steps, any_value(score) AS score, any_value(jump_count) AS jump_count FROM events JOIN s USING (user_id) LEFT JOIN m USING (user_id) GROUP BY user_id",
)
def trace_assembly(spark, sf):
    steps = load_table(spark, sf, "events").select("user_id", "event_id")
    scores = load_table(spark, sf, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("score"))
    metrics = jump_metrics(spark, sf).select("user_id", "jump_count").where("jump_count > 30")
    rows = H.assemble_traces(steps, scores, metrics, ["user_id"])
    return rows.groupBy("user_id").agg(F.count("*").alias("steps"), F.first("score").alias("score"), F.first("jump_count").alias("jump_count"))


@query("q_span_coverage", f"WITH d AS (SELECT * FROM ({DOCS})) SELECT round(coalesce(sum(words) FILTER (WHERE lang IN ('en', 'fr')), 0) / sum(words), 6) AS coverage, (SELECT string_agg(n, ',' ORDER BY n) FROM (SELECT DISTINCT lang || source AS n FROM d WHERE lang NOT IN ('en', 'fr') ORDER BY n LIMIT 20)) AS unmatched FROM d")
def span_coverage(spark, sf):
    rows = docs(spark, sf).withColumns({"matched": F.col("lang").isin("en", "fr"), "name": F.concat("lang", "source")})
    return rounded(L.weighted_coverage(rows, "matched", "words", "name").withColumn("unmatched", F.array_join("unmatched", ",")))


@query(
    "q_conditional_fractions",
    f"WITH d AS (SELECT *, words < 100 AS short FROM ({DOCS})) SELECT 'english_short' AS name, count(*) AS n, round(avg(short::INT), 6) AS fraction, coalesce(avg(short::INT) >= 0.5, false) AS passed FROM d WHERE lang = 'en' UNION ALL SELECT 'nobody', 0, NULL, true",
)
def conditional_fractions(spark, sf):
    rows = docs(spark, sf)
    short = F.col("words") < 100
    checks = [L.conditional_fraction(rows, F.col("lang") == "en", short, 0.5, False).select(F.lit("english_short").alias("name"), "*"), L.conditional_fraction(rows, F.col("lang") == "nobody", short, 0.5, True).select(F.lit("nobody").alias("name"), "*")]
    return rounded(checks[0].unionByName(checks[1]))


_TOP5 = "t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, doc_id) AS rank FROM c QUALIFY rank <= 5), b AS (SELECT query_id, predicted, CASE WHEN confidence IS NULL THEN 'open' WHEN confidence < 0.5 THEN 'yes_no' ELSE 'span' END AS answer_type, avg((level = predicted)::INT) AS p, max((level = predicted)::INT) AS hit FROM t GROUP BY ALL)"


@query("q_retrieval_breakdown", f"{_CAND}, {_TOP5} SELECT predicted, answer_type, count(*) AS n, round(avg(p), 6) AS mean_precision, round(avg(hit), 6) AS hit_rate FROM b GROUP BY GROUPING SETS ((), (predicted), (answer_type))")
def retrieval_breakdown(spark, sf):
    """Precision of the five nearest by predicted level and by answer type."""
    top = R.top_k(candidates(spark, sf, 5), "cosine", 5)
    kind = F.when(F.col("confidence").isNull(), "open").when(F.col("confidence") < 0.5, "yes_no").otherwise("span")
    right = (F.col("level") == F.col("predicted")).cast("int")
    per = top.groupBy("query_id", "predicted", kind.alias("answer_type")).agg(F.avg(right.cast("double")).alias("p"), F.max(right).alias("hit"))
    return rounded(per.groupingSets([[], ["predicted"], ["answer_type"]], "predicted", "answer_type").agg(F.count("*").alias("n"), F.avg("p").alias("mean_precision"), F.avg(F.col("hit").cast("double")).alias("hit_rate")))


_FOLDED = f"SELECT *, ((row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % 5)::INT AS fold FROM ({DOCS}) JOIN labels USING (doc_id)"


@query(
    "q_importance",
    f"WITH f AS ({_FOLDED}), i AS (SELECT fold, 'words' AS feature, abs(corr(words, quality)) AS v FROM f GROUP BY fold UNION ALL SELECT fold, 'n_chars', abs(corr(n_chars, quality)) FROM f GROUP BY fold) SELECT feature, count(v) AS folds, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM i GROUP BY feature",
)
def importance(spark, sf):
    rows = P.stratified_folds(labelled(spark, sf), "quality", "doc_id", order=[F.col("doc_id")])
    per = rows.groupBy("fold").agg(*(F.abs(F.corr(c, "quality")).alias(c) for c in ("words", "n_chars")))
    return rounded(S.importance_summary(per.unpivot(["fold"], ["words", "n_chars"], "feature", "importance"), "feature", "importance"))


# Samples and splits by the order of a digest, which other engines have too.
def digest_order(*columns: str):
    return F.md5(F.concat_ws("-", *(F.col(c).cast("string") for c in columns)))


@query("q_first_rows", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50")
def first_rows(spark, sf):
    return load_table(spark, sf, "documents").select("doc_id", "lang").orderBy("doc_id").limit(50)


@query("q_confidence_sample", f"WITH s AS (SELECT doc_id, quality || CASE WHEN words >= 100 THEN '-high' ELSE '-low' END AS stratum FROM ({DOCS}) JOIN labels USING (doc_id)) SELECT doc_id, stratum FROM s QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5(doc_id::VARCHAR)) <= CASE stratum WHEN '1-high' THEN 12 WHEN '1-low' THEN 8 WHEN '0-high' THEN 5 WHEN '0-low' THEN 3 END")
def confidence_sample(spark, sf):
    rows = labelled(spark, sf).select("doc_id", F.concat(F.col("quality").cast("string"), F.when(F.col("words") >= 100, "-high").otherwise("-low")).alias("stratum"))
    return P.quota_sample(rows, "stratum", {"1-high": 12, "1-low": 8, "0-high": 5, "0-low": 3}, "doc_id", order=digest_order("doc_id"))


@query("q_class_sample", "SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR)) <= 10")
def class_sample(spark, sf):
    return P.per_class(load_table(spark, sf, "documents").select("lang", "doc_id"), "lang", 10, [digest_order("doc_id")])


@query("q_pool_sample", "WITH p AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'poor' ELSE 'good' END AS pool FROM labels) SELECT doc_id, pool FROM p QUALIFY row_number() OVER (PARTITION BY pool ORDER BY md5(doc_id::VARCHAR)) <= CASE pool WHEN 'toxic' THEN 5 WHEN 'poor' THEN 7 ELSE 9 END")
def pool_sample(spark, sf):
    pools = [("toxic", F.col("toxic") == 1, 5), ("poor", F.col("quality") == 0, 7), ("good", F.lit(True), 9)]
    return P.priority_quota_sample(load_table(spark, sf, "labels"), pools, "doc_id", order=digest_order("doc_id")).select("doc_id", "pool")


@query("q_group_sample_ordered", "SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM (SELECT DISTINCT source FROM documents) ORDER BY md5(source), source LIMIT 5)")
def group_sample_ordered(spark, sf):
    return P.group_sample(load_table(spark, sf, "documents").select("doc_id", "source"), "source", 5, order=digest_order("source"))


@query("q_majority_group_split", "WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), m AS (SELECT source, arg_min(lang, (-n, lang)) AS lang FROM c GROUP BY source), s AS (SELECT source, CASE WHEN (row_number() OVER (PARTITION BY lang ORDER BY md5(source)) - 1) / count(*) OVER (PARTITION BY lang) < 0.5 THEN 'train' ELSE 'test' END AS split FROM m) SELECT split, count(*) AS rows, count(DISTINCT source) AS sources FROM documents JOIN s USING (source) GROUP BY split")
def majority_group_split(spark, sf):
    rows = P.majority_group_split(load_table(spark, sf, "documents").select("source", "lang"), "source", "lang", [("train", 0.5), ("test", 0.5)], order=[digest_order("source")])
    return rows.groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct("source").alias("sources"))


@query("q_anchor_chunks", "WITH t AS (SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) ORDER BY md5(conv_id::VARCHAR), conv_id LIMIT 12) SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM t) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY md5(conv_id || '-' || turn), turn) <= 2")
def anchor_chunks(spark, sf):
    return P.anchor_chunks(load_table(spark, sf, "conversations").select("conv_id", "turn"), "conv_id", "turn", 12, 2, digest_order)


@query("q_prefix_split", "WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents) SELECT CASE WHEN place < 60 THEN 'construction' WHEN place < 100 THEN 'validation' ELSE 'evaluation' END AS split, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM p GROUP BY 1")
def prefix_split(spark, sf):
    rows = P.prefix_split(load_table(spark, sf, "documents").select("doc_id"), "doc_id", [("construction", 60), ("validation", 40)], "evaluation")
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


# Bootstraps: 100 resamples of all labelled rows.
_B = 100
_MIX = "((((resample * 1103515245 + draw * 12345 + 42) % 2147483647) * 48271) % 2147483647 * 16807) % 2147483647"


def _boot(rows: str) -> str:
    return f"WITH v AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM ({rows})), n AS (SELECT count(*) AS n FROM v), d AS (SELECT resample, draw, ({_MIX}) % n AS i FROM range({_B}) a(resample), n, range((SELECT n FROM n)) b(draw)), s AS (SELECT resample, draw, v.* FROM d JOIN v USING (i))"


_SCORED = f"SELECT doc_id, quality, words::DOUBLE AS words, (n_chars / words)::DOUBLE AS width FROM ({DOCS}) JOIN labels USING (doc_id) WHERE words > 0"
_AUC = lambda x: f"SELECT resample, (sum(r) FILTER (WHERE quality = 1) - count(*) FILTER (WHERE quality = 1) * (count(*) FILTER (WHERE quality = 1) + 1) / 2) / (count(*) FILTER (WHERE quality = 1) * count(*) FILTER (WHERE quality = 0)) AS x FROM (SELECT resample, quality, rank() OVER (PARTITION BY resample ORDER BY {x}) + (count(*) OVER (PARTITION BY resample, {x}) - 1) / 2.0::DOUBLE AS r FROM s) GROUP BY resample"
_CI = "count(x) AS resamples, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high"


def scored(spark, sf) -> DataFrame:
    return labelled(spark, sf).where("words > 0").select("doc_id", "quality", F.col("words").cast("double").alias("words"), (F.col("n_chars") / F.col("words")).alias("width"))


@query("q_paired_bootstrap", f"{_boot(f'SELECT doc_id, quality - (words >= 100)::INT AS v FROM ({DOCS}) JOIN labels USING (doc_id)')}, m AS (SELECT resample, avg(v) AS x FROM s GROUP BY resample) SELECT {_CI}, round(avg((x <= 0)::INT), 6) AS p_one_tailed FROM m")
def paired_bootstrap(spark, sf):
    """Mean of the paired differences of two 0/1 columns."""
    rows = labelled(spark, sf).select("doc_id", (F.col("quality") - (F.col("words") >= 100).cast("int")).cast("double").alias("difference"))
    means = S.bootstrap_means(rows, "difference", "doc_id", _B)
    tail = means.agg(F.avg((F.col("mean") <= 0).cast("double")).alias("p_one_tailed"))
    return rounded(S.interval(means, "mean").crossJoin(tail))


@query("q_bootstrap_rho", f"{_boot(_SCORED)}, r AS (SELECT resample, rank() OVER (PARTITION BY resample ORDER BY words) + (count(*) OVER (PARTITION BY resample, words) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY resample ORDER BY width) + (count(*) OVER (PARTITION BY resample, width) - 1) / 2.0::DOUBLE AS b FROM s), m AS (SELECT resample, corr(a, b) AS x FROM r GROUP BY resample) SELECT {_CI} FROM m")
def bootstrap_rho(spark, sf):
    rows = S.repeated(S.drawn(scored(spark, sf), "doc_id", _B))
    return rounded(S.interval(S.spearman(rows, "words", "width", ["resample"]), "rho"))


@query("q_bootstrap_auc", f"{_boot(_SCORED)}, m AS ({_AUC('words')}) SELECT {_CI} FROM m")
def bootstrap_auc(spark, sf):
    rows = S.repeated(S.drawn(scored(spark, sf), "doc_id", _B))
    return rounded(S.interval(S.auc(rows, "quality", "words", ["resample"]), "auc"))


@query("q_bootstrap_error", f"{_boot(_SCORED)}, m AS (SELECT resample, avg(abs(width - 6)) AS x, 1 - sum((width - 6) * (width - 6)) / sum(width * width) AS share FROM s GROUP BY resample) SELECT {_CI}, round(avg(share), 6) AS explained FROM m")
def bootstrap_error(spark, sf):
    """Mean absolute error of a constant prediction, and the share of squares that it explains."""
    rows = S.drawn(scored(spark, sf), "doc_id", _B)
    times, error = F.col("__times"), F.col("width") - 6
    per = rows.groupBy("resample").agg((F.sum(F.abs(error) * times) / F.sum(times)).alias("mae"), (1 - F.sum(error * error * times) / F.sum(F.col("width") * F.col("width") * times)).alias("share"))
    return rounded(S.interval(per, "mae").crossJoin(per.agg(F.avg("share").alias("explained"))))


@query("q_auc_difference", f"{_boot(_SCORED)}, a AS ({_AUC('words')}), b AS ({_AUC('width')}), m AS (SELECT resample, a.x - b.x AS x FROM a JOIN b USING (resample)), c AS (SELECT {_CI} FROM m) SELECT *, CASE WHEN mean >= 0.03 AND low > 0 THEN 'win' WHEN mean <= -0.03 AND high < 0 THEN 'regress' ELSE 'inconclusive' END AS verdict FROM c")
def auc_difference(spark, sf):
    return rounded(S.auc_difference(scored(spark, sf), "quality", "words", "width", "doc_id", _B))


@query("q_operating_points", f"{_ATT}, s AS (SELECT correct::INT AS y, row_number() OVER (ORDER BY score DESC, event_id) AS place, sum(correct::INT) OVER (ORDER BY score DESC, event_id ROWS UNBOUNDED PRECEDING) AS hits, count(*) OVER () AS n FROM att WHERE score IS NOT NULL), p AS (SELECT i, greatest(round((SELECT max(n) FROM s) * i / 20), 1)::BIGINT AS size FROM range(1, 21) r(i)) SELECT round(i / 20, 6) AS coverage, round(hits / place, 6) AS accuracy FROM p JOIN s ON place = size WHERE i = 4")
def operating_points(spark, sf):
    """The coverage-risk curve at the fixed coverage of one attempt in five."""
    curve = A.coverage_risk(attempts(spark, sf).withColumn("y", F.col("correct").cast("int")), "score", "y", "event_id")
    points = spark.createDataFrame([(0.2,)], "point double")
    return rounded(curve.join(points, F.abs(F.col("coverage") - F.col("point")) < 1e-9).select("coverage", "accuracy"))


# Axes
@query("q_layer_differences", "WITH d AS (SELECT vec_id % 4 AS layer, label % 3 AS lvl, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT layer, i, avg(x) FILTER (WHERE lvl = 2) - avg(x) FILTER (WHERE lvl = 0) AS d FROM d GROUP BY ALL), n AS (SELECT layer, sqrt(sum(d * d)) AS norm FROM m GROUP BY layer) SELECT layer, round(norm, 6) AS norm, norm = max(norm) OVER () AS largest FROM n")
def layer_differences(spark, sf):
    rows = load_table(spark, sf, "embeddings").select((F.col("vec_id") % 4).alias("layer"), (F.col("label") % 3).alias("lvl"), "embedding")
    return rounded(axes.layer_differences(rows, "layer", "lvl", "embedding", 0, 2))


@query("q_discriminant_axis")
def discriminant_axis(spark, sf):
    """Classes along the discriminant axis, and its cosine with the centroid axis."""
    v = load_table(spark, sf, "embeddings").withColumn("lvl", F.col("label") % 3)
    axis, other = axes.discriminant_axis(v, "lvl", "embedding", 0, 2), axes.centroid_axis(v, "lvl", "embedding", 0, 2)
    valid = axes.validate_axis(v.select("lvl", axes.project(F.col("embedding"), axis).alias("p")), "lvl", "p", 0, 1, 2)
    return rounded(valid.withColumn("cosine", F.lit(float(axes.axis_cosine(axis, other)))))


@query("q_axis_features")
def axis_features(spark, sf):
    """Mean, variance, range and drift of each trace along the axis."""
    v = load_table(spark, sf, "embeddings").withColumns({"lvl": F.col("label") % 3, "trace": F.floor(F.col("vec_id") / 10)})
    axis = axes.centroid_axis(v, "lvl", "embedding", 0, 2)
    return rounded(axes.axis_features(v, "trace", "vec_id", "embedding", axis))


# Correlations with their p values
@query("q_spearman_p")
def spearman_p(spark, sf):
    """Rho per language with its p value, corrected for the number of languages."""
    per = S.spearman(labelled(spark, sf).withColumn("words", F.col("words").cast("double")), "words", "n_chars", ["lang"])
    rows = per.orderBy("lang").collect()  # a row per language
    return rounded(spark.createDataFrame([(r.lang, r.n, r.rho, S.correlation_p(r.rho, r.n), S.correlation_p(r.rho, r.n, len(rows))) for r in rows], "lang string, n bigint, rho double, p double, p_bonferroni double"))


# Models without SQL
def _accuracy(out: DataFrame, label: str) -> DataFrame:
    return out.agg(F.count("*").alias("n"), F.round(F.avg((F.col("prediction") == F.col(label)).cast("double")), 6).alias("accuracy"))


@query("q_binary_fallback")
def binary_fallback(spark, sf):
    """Probe of the two outer levels alone."""
    v = load_table(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") % 3).alias("lvl")).where("lvl <> 1").withColumn("lvl", F.col("lvl") / 2)
    rows = P.group_split(v, "vec_id", [("train", 0.8), ("test", 0.2)])
    return _accuracy(M.probe(rows.where("split = 'train'"), rows.where("split = 'test'"), "lvl", "embedding", (0.1,)), "lvl")


@query("q_section_transfer")
def section_transfer(spark, sf):
    """A classifier trained on one half of the sources and tested on the other."""
    rows = P.group_split(doc_features(spark, sf).join(load_table(spark, sf, "documents").select("doc_id", "source"), "doc_id"), "source", [("train", 0.5), ("test", 0.5)])
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    scaler = M.Scaler(train, _COLUMNS)
    return _accuracy(M.logistic(scaler.apply(train), "quality").transform(scaler.apply(test)), "quality")


@query("q_feature_ablation")
def feature_ablation(spark, sf):
    """Training accuracy of each group of features alone and of all together."""
    rows = doc_features(spark, sf)
    out = None
    for name, columns in {"surface": ["entity_density", "exclaims", "bars"], "diversity": ["distinct_share"], "length": ["words"], "all": [*_COLUMNS, "words"]}.items():
        ready = M.Scaler(rows, columns).apply(rows)
        one = _accuracy(M.logistic(ready, "quality").transform(ready), "quality").select(F.lit(name).alias("features"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("q_length_baseline")
def length_baseline(spark, sf):
    """Out-of-fold AUC of the length alone, pooled over two ways of dealing the folds."""
    rows = doc_features(spark, sf).select("doc_id", "quality", "words")
    runs = [M.out_of_fold(P.stratified_folds(rows, "quality", "doc_id", 2, [P.hash_order("doc_id", seed=seed), "doc_id"]), "doc_id", "quality", ["words"]) for seed in (1, 2)]
    return rounded(S.auc(runs[0].unionByName(runs[1]), "quality", "prob"))


@query("q_category_leakage")
def category_leakage(spark, sf):
    """One-vs-rest AUC of a category from the features, and from what would leak it."""
    rows = docs(spark, sf).select("doc_id", (F.col("lang") == "en").cast("int").alias("target"), F.col("words").cast("double").alias("words"), F.regexp_count("text", F.lit(" the ")).cast("double").alias("leak"))
    folds = P.stratified_folds(rows, "target", "doc_id", 2, [F.col("doc_id")])
    out = None
    for name, columns in {"length": ["words"], "leak": ["leak"]}.items():
        one = S.auc(M.out_of_fold(folds, "doc_id", "target", columns), "target", "prob").select(F.lit(name).alias("features"), "*")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query("q_query_level_classifier")
def query_level_classifier(spark, sf):
    """Level classifier over query vectors, and over the mean of each query's vector and its nearest row's."""
    nearest = R.top_k(candidates(spark, sf, 1), "cosine", 1).select("query_id", "doc_id")
    v = load_table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), (F.col("label") % 3).alias("lvl"))
    plain = v.join(nearest, F.col("vec_id") == F.col("query_id")).select("vec_id", "doc_id", "lvl", "e")
    other = plain.join(v.select(F.col("vec_id").alias("doc_id"), F.col("e").alias("f")), "doc_id")
    mixed = other.select("vec_id", "lvl", F.zip_with("e", "f", lambda a, b: (a + b) / 2).alias("e"))
    train = v.where("vec_id % 100 <> 0").select("vec_id", "lvl", "e")
    tests = plain.select("vec_id", "lvl", "e").withColumn("variant", F.lit("question")).unionByName(mixed.withColumn("variant", F.lit("with_hypothetical_answer")))
    out = M.probe(train, tests, "lvl", "e", (0.1,))
    return out.groupBy("variant").agg(F.count("*").alias("n"), F.round(F.avg((F.col("prediction") == F.col("lvl")).cast("double")), 6).alias("accuracy"))
