"""Queries over attempts, detectors, records, ratings and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import python_text as T
from ..functions import text as X
from ..functions import vectors as V
from ..operators import attempts as A
from ..operators import detectors as D
from ..operators import models as M
from ..operators import ratings as R
from ..operators import sampling as P
from ..operators import shaping as H
from ..operators import statistics as S
from ..sources import load_table, stored
from .registry import query
from .text_queries import docs, labelled
from .trace_queries import levelled_events, rounded, traces_of_values

# Attempts: a problem is five successive events of a user, which are its runs 0 to 4 (the last problem may have fewer);
# an attempt is correct for click and purchase, has an answer unless it is an error, and its score is the value unless it is a view.
_ATT = """WITH r AS (SELECT user_id, event_id, event_type, value, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS run_order FROM events),
att AS (SELECT user_id || '-' || (run_order // 5) AS id, user_id % 3 AS subject, event_id, run_order % 5 AS run_order, CASE WHEN event_type <> 'error' THEN event_type END AS answer, event_type <> 'error' AS answered, event_type IN ('click', 'purchase') AS correct, CASE WHEN event_type <> 'view' THEN value END AS score FROM r)"""


def attempts(spark, sf) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.col("event_type")
    rows = load_table(spark, sf, "events").withColumn("place", (F.row_number().over(w) - 1).cast("int"))
    problem = F.concat_ws("-", F.col("user_id").cast("string"), F.floor(F.col("place") / 5).cast("string"))
    return rows.select(problem.alias("id"), (F.col("user_id") % 3).alias("subject"), "event_id", (F.col("place") % 5).alias("run_order"), F.when(kind != "error", kind).alias("answer"), (kind != "error").alias("answered"), kind.isin("click", "purchase").alias("correct"), F.when(kind != "view", F.col("value")).alias("score"))


_BEST = "b AS (SELECT * FROM att QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC NULLS LAST, answered DESC, run_order) = 1)"


@query("q_best_of_n", f"{_ATT}, {_BEST} SELECT id, run_order, correct FROM b")
def best_of_n(spark, sf):
    return A.best_attempt(attempts(spark, sf), "id", "score", "answered", "run_order").select("id", "run_order", "correct")


@query("q_selection_summary", f"{_ATT}, {_BEST}, p AS (SELECT id, avg(correct::INT) AS m, max(correct::INT) AS a FROM att GROUP BY id) SELECT count(*) AS problems, round(avg(m), 6) AS pass_at_1, round(avg(a), 6) AS pass_at_k, (SELECT round(avg(correct::INT), 6) FROM b) AS selected FROM p")
def selection_summary(spark, sf):
    rows = attempts(spark, sf)
    return rounded(A.selection_summary(rows, A.best_attempt(rows, "id", "score", "answered", "run_order"), "id", "correct"))


@query("q_pass_at_k", f"{_ATT}, p AS (SELECT id, any_value(subject) AS subject, avg(correct::INT) AS m, max(correct::INT) AS a FROM att GROUP BY id) SELECT subject, count(*) AS problems, round(avg(m), 6) AS pass_at_1, round(avg(a), 6) AS pass_at_k FROM p GROUP BY subject")
def pass_at_k(spark, sf):
    return rounded(A.pass_at_k(attempts(spark, sf), "id", "correct", "subject"))


@query("q_plurality_vote", f"{_ATT}, n AS (SELECT id, count(*) AS n FROM att GROUP BY id), v AS (SELECT id, answer, count(*) AS votes, min(run_order) AS f, avg(correct::INT) AS r FROM att WHERE answer IS NOT NULL GROUP BY ALL), t AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY votes DESC, f) = 1) SELECT id, answer, coalesce(votes, 0)::BIGINT AS votes, round(coalesce(votes, 0) / n, 6) AS consistency, coalesce(r >= 0.5, false) AS vote_correct FROM n LEFT JOIN t USING (id)")
def plurality_vote(spark, sf):
    return rounded(A.plurality_vote(attempts(spark, sf), "id", "answer", "run_order", "correct"))


@query("q_coverage_risk", f"{_ATT}, s AS (SELECT correct::INT AS y, row_number() OVER (ORDER BY score DESC, event_id) AS place, sum(correct::INT) OVER (ORDER BY score DESC, event_id ROWS UNBOUNDED PRECEDING) AS hits, count(*) OVER () AS n FROM att WHERE score IS NOT NULL), p AS (SELECT i, i / 20 AS coverage, greatest(round((SELECT max(n) FROM s) * i / 20), 1)::BIGINT AS size FROM range(1, 21) r(i)) SELECT round(coverage, 6) AS coverage, place AS kept, round(hits / place, 6) AS accuracy, round(1 - hits / place, 6) AS risk FROM p JOIN s ON place = size")
def coverage_risk(spark, sf):
    return rounded(A.coverage_risk(attempts(spark, sf).withColumn("y", F.col("correct").cast("int")), "score", "y", "event_id"))


@query("q_precision_at_fraction", f"{_ATT}, s AS (SELECT row_number() OVER (ORDER BY score DESC, event_id) AS place, sum(correct::INT) OVER (ORDER BY score DESC, event_id ROWS UNBOUNDED PRECEDING) AS hits, count(*) OVER () AS n FROM att WHERE score IS NOT NULL) SELECT f::DOUBLE AS fraction, place AS kept, round(hits / place, 6) AS precision FROM s JOIN (VALUES (0.1), (0.25), (0.5)) v(f) ON place = greatest(floor(n * f), 1)")
def precision_at_fraction(spark, sf):
    return rounded(A.precision_at_fraction(attempts(spark, sf).withColumn("y", F.col("correct").cast("int")), "score", "y", "event_id"))


@query("q_vote_threshold", f"{_ATT}, v AS (SELECT id, answer, count(*) AS votes, min(run_order) AS f, avg(correct::INT) AS r FROM att WHERE answer IS NOT NULL GROUP BY ALL), t AS (SELECT *, r >= 0.5 AS ok FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY votes DESC, f) = 1), a AS (SELECT coalesce(votes, 0) AS votes, coalesce(ok, false) AS ok FROM (SELECT DISTINCT id FROM att) LEFT JOIN t USING (id)) SELECT k AS threshold, count(*) FILTER (WHERE votes >= k) AS kept, round(count(*) FILTER (WHERE votes >= k) / count(*), 6) AS coverage, round(avg(ok::INT) FILTER (WHERE votes >= k), 6) AS accuracy FROM a, (VALUES (1.0::DOUBLE), (2), (3), (4), (5)) v(k) GROUP BY k")
def vote_threshold(spark, sf):
    votes = A.plurality_vote(attempts(spark, sf), "id", "answer", "run_order", "correct")
    return rounded(A.threshold_coverage(votes, "votes", "vote_correct", [1.0, 2.0, 3.0, 4.0, 5.0]))


@query("q_signed_confidence", f"{_ATT}, c AS (SELECT correct, CASE WHEN correct THEN value ELSE -value END AS s FROM att JOIN (SELECT event_id, value FROM events) USING (event_id)) SELECT k AS threshold, count(*) FILTER (WHERE s >= k) AS kept, round(count(*) FILTER (WHERE s >= k) / count(*), 6) AS coverage, round(avg(correct::INT) FILTER (WHERE s >= k), 6) AS accuracy FROM c, (VALUES (0.0::DOUBLE), (25), (50), (75), (90)) v(k) GROUP BY k")
def signed_confidence(spark, sf):
    rows = attempts(spark, sf).join(load_table(spark, sf, "events").select("event_id", "value"), "event_id")
    return rounded(A.threshold_coverage(rows.withColumn("s", V.signed_confidence(F.col("correct"), F.col("value"))), "s", "correct", [0.0, 25.0, 50.0, 75.0, 90.0]))


@query("q_run_metrics", f"{_ATT} SELECT run_order, count(*) AS n, round(avg(correct::INT), 6) AS accuracy, round(avg(answered::INT), 6) AS answered, round(avg(score), 6) AS mean_score FROM att GROUP BY run_order")
def run_metrics(spark, sf):
    return rounded(attempts(spark, sf).groupBy("run_order").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg(F.col("answered").cast("double")).alias("answered"), F.avg("score").alias("mean_score")))


@query("q_helped_or_hurt", "WITH m AS (SELECT user_id, event_type, round(avg(value), 6) AS v FROM events GROUP BY ALL), o AS (SELECT user_id, v AS own FROM m WHERE event_type = 'purchase'), b AS (SELECT user_id, max(v) AS best, arg_max(event_type, (v, event_type)) AS best_baseline FROM m WHERE event_type IN ('view', 'click') GROUP BY user_id) SELECT user_id, own, best, best_baseline, CASE WHEN own - best > 0.01 THEN 'helped' WHEN own - best < -0.01 THEN 'hurt' ELSE 'neutral' END AS verdict FROM o JOIN b USING (user_id)")
def helped_or_hurt(spark, sf):
    means = load_table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("v"))
    return A.helped_or_hurt(means, "user_id", "event_type", "v", "purchase", ["view", "click"])


# Detectors: features of each user's values; success is a share of purchases above a fifth.
def detector_features(spark, sf) -> DataFrame:
    t = traces_of_values(spark, sf).withColumn("cut", (F.size("raw") / 2).cast("int")).where("cut > 0")
    halves = t.select("user_id", "xs", F.expr("slice(raw, 1, cut)").alias("r"), F.expr("slice(raw, cut + 1, size(raw))").alias("a"), F.size("raw").alias("reasoning_n_chunks"))
    halves = stored(halves.withColumn("ys", V.interpolate(V.centred(F.col("a")), 20)), "detector_series")
    features, cross = V.trajectory_features(F.col("xs"), "reasoning"), V.cross_features(F.col("r"), F.col("a"))
    of_answer = V.trajectory_features(F.col("ys"), "answer")
    wide = halves.select("user_id", "reasoning_n_chunks", *(features[f"reasoning_{n}"].alias(f"reasoning_{n}") for n in ("direction_changes", "monotonicity", "fall_from_peak")), *(of_answer[f"answer_{n}"].alias(f"answer_{n}") for n in ("direction_changes", "max_rise", "monotonicity")), *(c.alias(n) for n, c in cross.items()))
    # A trace that ends in an error was cut off.
    status = F.when(F.max_by("event_type", F.struct("ts", "event_id")) == "error", "exit_cost").otherwise("submitted")
    outcome = load_table(spark, sf, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") == "purchase") > F.count("*") / 5).cast("int").alias("target"), X.truncated(status).alias("truncated"))
    rounded_ = [F.round(c, 6).alias(c) if c not in ("user_id", "reasoning_n_chunks") else F.col(c) for c in wide.columns]  # ties are ties in any engine
    return stored(wide.select(*rounded_).join(outcome, "user_id"), "detector_features")


def _features_sql() -> str:
    from .trace_queries import _ARR, _FEAT

    base = _FEAT.replace("WITH ev", "ev", 1)
    head, _, tail = base.rpartition("SELECT user_id, round(max(x) FILTER (WHERE j = 0)")
    feats = f"f AS (SELECT user_id, round(max(x) FILTER (WHERE j = 0){tail})"
    # The same features of the second halves: an inner table of the arrays takes the place of the outer one.
    answers = f"fa AS (WITH a AS (SELECT user_id, n - n // 2 AS n, xs[(n // 2)::INT + 1:] AS xs FROM a0 WHERE n // 2 > 0){_FEAT[len(_ARR):]})"
    return f"""WITH {head.rstrip()}, {feats}, a0 AS (SELECT * FROM a), {answers},
xx AS (SELECT user_id, xs[1:(n // 2)::INT] AS r, xs[(n // 2)::INT + 1:] AS a, n FROM a WHERE n // 2 > 0),
w AS (SELECT f.user_id, xx.n AS nc, f.r_direction_changes AS dc, f.r_monotonicity AS mo, f.r_fall_from_peak AS ff, round(xx.a[1] - xx.r[-1], 6) AS ad, round((list_max(xx.a) - list_min(xx.a)) - (list_max(xx.r) - list_min(xx.r)), 6) AS ov, fa.r_direction_changes AS adc, fa.r_max_rise AS amr, fa.r_monotonicity AS amo FROM f JOIN xx USING (user_id) JOIN fa USING (user_id)),
o AS (SELECT user_id, (arg_max(event_type, (ts, event_id)) = 'error')::INT AS tr, (count(*) FILTER (WHERE event_type = 'purchase') > count(*) / 5)::INT AS target FROM events GROUP BY user_id),
l AS (SELECT user_id, target, 'premature_exit' AS detector, -nc::DOUBLE AS score FROM w JOIN o USING (user_id) UNION ALL SELECT user_id, target, 'rambling_overlong', nc::DOUBLE FROM w JOIN o USING (user_id) UNION ALL SELECT user_id, target, 'thrashing', dc::DOUBLE FROM w JOIN o USING (user_id)
 UNION ALL SELECT user_id, target, 'no_commitment', -mo FROM w JOIN o USING (user_id) UNION ALL SELECT user_id, target, 'derailment_late', ff FROM w JOIN o USING (user_id) UNION ALL SELECT user_id, target, 'answer_drift', abs(ad) FROM w JOIN o USING (user_id) UNION ALL SELECT user_id, target, 'answer_overrange', ov FROM w JOIN o USING (user_id)
 UNION ALL SELECT user_id, target, 'answer_meandering', adc::DOUBLE FROM w JOIN o USING (user_id) UNION ALL SELECT user_id, target, 'answer_volatility', amr FROM w JOIN o USING (user_id) UNION ALL SELECT user_id, target, 'answer_uncommitted', -amo FROM w JOIN o USING (user_id) UNION ALL SELECT user_id, target, 'truncation_abort', tr::DOUBLE FROM w JOIN o USING (user_id)),
th AS (SELECT detector, CASE WHEN detector = 'truncation_abort' THEN 0.5::DOUBLE WHEN count(*) FILTER (WHERE target = 1) >= 3 THEN quantile_cont(score, 0.9) FILTER (WHERE target = 1) ELSE quantile_cont(score, 0.9) END AS threshold FROM l GROUP BY detector),
fl AS (SELECT *, coalesce(score > threshold, false) AS flag FROM l JOIN th USING (detector))"""


_DET = _features_sql()


def flagged(spark, sf) -> DataFrame:
    return D.flags(D.scores(detector_features(spark, sf), "user_id", "target"), "target")


@query("q_detector_flags", f"{_DET} SELECT user_id, detector, round(score, 10) + 0.0 AS score, round(threshold, 10) + 0.0 AS threshold, flag FROM fl")
def detector_flags(spark, sf):
    return rounded(flagged(spark, sf).drop("target"), 10)


@query("q_detector_eval", f"{_DET}, rk AS (SELECT detector, 1 - target AS failed, flag, rank() OVER (PARTITION BY detector ORDER BY score) + (count(*) OVER (PARTITION BY detector, score) - 1) / 2.0::DOUBLE AS r FROM fl), s AS (SELECT detector, count(*) AS n, sum(failed) AS p, sum(r) FILTER (WHERE failed = 1) AS sr, count(*) FILTER (WHERE flag) AS flagged, count(*) FILTER (WHERE flag AND failed = 1) AS hits FROM rk GROUP BY detector) SELECT detector, n, round((sr - p * (p + 1) / 2) / (p * (n - p)), 6) AS auc, flagged, round(CASE WHEN flagged > 0 THEN hits / flagged END, 6) AS precision, round(CASE WHEN p > 0 THEN hits / p END, 6) AS recall, round(CASE WHEN flagged > 0 THEN hits / flagged / (p / n) END, 6) AS lift FROM s")
def detector_eval(spark, sf):
    return rounded(D.evaluate(flagged(spark, sf), "target"))


@query("q_mode_coverage", f"{_DET}, u AS (SELECT user_id, max(1 - target) AS failed, bool_or(flag) AS a FROM fl GROUP BY user_id) SELECT count(*) AS n, sum(failed)::BIGINT AS failures, count(*) FILTER (WHERE a) AS flagged, count(*) FILTER (WHERE a AND failed = 1) AS hits, round(count(*) FILTER (WHERE a AND failed = 1) / sum(failed), 6) AS union_recall, round(count(*) FILTER (WHERE a AND failed = 1) / count(*) FILTER (WHERE a), 6) AS union_precision FROM u")
def mode_coverage(spark, sf):
    return rounded(D.coverage(flagged(spark, sf), "user_id", "target"))


# Records
@query("q_role_chunks", "SELECT conv_id, len(c)::INT AS n, c[1] AS first_chunk FROM (SELECT conv_id, list(text ORDER BY turn) FILTER (WHERE role = 'assistant') AS c FROM conversations GROUP BY conv_id) WHERE c IS NOT NULL")
def role_chunks(spark, sf):
    messages = load_table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    chunks = messages.select("conv_id", H.role_chunks(F.col("m"), "assistant").alias("c")).where(F.size("c") > 0)
    return chunks.select("conv_id", F.size("c").alias("n"), F.get("c", F.lit(0)).alias("first_chunk"))


@query("q_episodes", "SELECT conv_id, count(*) AS n_steps, arg_min(text, turn) AS first, arg_max(text, turn) AS last, md5(string_agg(text, '|' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def episodes(spark, sf):
    out = H.episodes(load_table(spark, sf, "conversations"), ["conv_id"], "turn", "text")
    return out.select("conv_id", "n_steps", "first", "last", F.md5(F.array_join("chunks", "|")).alias("digest"))


@query("q_coalesce_chunks", "WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS ts, count(*) AS n FROM conversations GROUP BY conv_id), g AS (SELECT conv_id, i, CASE WHEN n <= 3 THEN ts[i + 1] ELSE array_to_string(ts[(i * n // 3) + 1:((i + 1) * n // 3)], chr(10) || chr(10)) END AS t FROM c, range(3) r(i) WHERE i < least(n, 3)) SELECT conv_id, i::INT AS part, md5(t) AS digest FROM g")
def coalesce_chunks(spark, sf):
    chunks = load_table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("c"))
    return chunks.select("conv_id", F.posexplode(X.coalesce_chunks(F.col("c"), 3)).alias("part", "t")).select("conv_id", "part", F.md5("t").alias("digest"))


@query("q_consecutive_pairs", "SELECT conv_id, turn AS \"left\", lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS \"right\" FROM conversations QUALIFY \"right\" IS NOT NULL")
def consecutive_pairs(spark, sf):
    return H.consecutive_pairs(load_table(spark, sf, "conversations"), "conv_id", "turn")


@query("q_all_pairs", 'SELECT a.conv_id, a.turn AS "left", b.turn AS "right" FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn')
def all_pairs(spark, sf):
    return H.pairs_within(load_table(spark, sf, "conversations"), "conv_id", "turn")


@query("q_alignment_check", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'only_left' WHEN a.doc_id IS NULL THEN 'only_right' ELSE 'differs' END AS problem FROM (SELECT doc_id, (n_chars >= 500)::INT AS v FROM documents) a FULL JOIN (SELECT doc_id, quality AS v FROM labels) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.v IS DISTINCT FROM b.v")
def alignment_check(spark, sf):
    documents = load_table(spark, sf, "documents").select("doc_id", (F.col("n_chars") >= 500).cast("int").alias("v"))
    return H.misaligned(documents, load_table(spark, sf, "labels").select("doc_id", F.col("quality").cast("int").alias("v")), "doc_id", "v")


@query("q_multi_key_lookup", "WITH d AS (SELECT doc_id, doc_id + 100000 AS k1, doc_id * 2 AS k2, doc_id AS k3 FROM documents) SELECT d.doc_id, coalesce(a.quality, b.quality, c.quality) AS quality FROM d LEFT JOIN labels a ON a.doc_id = k1 LEFT JOIN labels b ON b.doc_id = k2 LEFT JOIN labels c ON c.doc_id = k3")
def multi_key_lookup(spark, sf):
    d = load_table(spark, sf, "documents").select("doc_id", (F.col("doc_id") + 100000).alias("k1"), (F.col("doc_id") * 2).alias("k2"), F.col("doc_id").alias("k3"))
    return H.multi_key_lookup(d, "doc_id", ["k1", "k2", "k3"], load_table(spark, sf, "labels").select(F.col("doc_id").alias("k"), "quality"), "k", "quality").select("doc_id", "quality")


@query("q_merge_last", "WITH l AS (SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1), c AS (SELECT c_custkey AS user_id, c_name FROM customer) SELECT 'hit' AS side, count(*) AS n FROM c JOIN l USING (user_id) UNION ALL SELECT 'miss', count(*) FROM c WHERE user_id NOT IN (SELECT user_id FROM l)")
def merge_last(spark, sf):
    customers = load_table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    hits, misses = H.merge_last(customers, load_table(spark, sf, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id")
    return hits.agg(F.lit("hit").alias("side"), F.count("*").alias("n")).unionByName(misses.agg(F.lit("miss").alias("side"), F.count("*").alias("n")))


@query("q_questions", "WITH e AS (SELECT user_id, list_sort(list_distinct(flatten(list([event_type, CASE WHEN value > 80 THEN 'high' ELSE '' END])))) AS g FROM events GROUP BY user_id) SELECT user_id, array_to_string(list_filter(g, lambda x: x <> ''), ',') AS gold FROM e")
def questions(spark, sf):
    e = load_table(spark, sf, "events").groupBy("user_id").agg(F.collect_list(F.array("event_type", F.when(F.col("value") > 80, "high").otherwise(""))).alias("evidence"))
    return H.questions(e, "evidence").select("user_id", F.array_join("gold_evidence", ",").alias("gold"))


@query("q_annotator_majority", "WITH v AS (SELECT user_id, list(value > 50 ORDER BY ts, event_id) AS v FROM events GROUP BY user_id) SELECT user_id, CASE WHEN len(list_filter(v, lambda x: x)) > len(list_filter(v, lambda x: NOT x)) THEN true WHEN len(list_filter(v, lambda x: x)) < len(list_filter(v, lambda x: NOT x)) THEN false ELSE v[1] END AS verdict FROM v")
def annotator_majority(spark, sf):
    votes = load_table(spark, sf, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda s: s["value"] > 50).alias("v"))
    return votes.select("user_id", H.annotator_majority(F.col("v")).alias("verdict"))


@query("q_error_step", "SELECT conv_id, least(greatest((conv_id % 9)::INT - 1, 0), count(*)::INT - 1) AS step, round(CASE WHEN count(*) > 1 THEN least(greatest((conv_id % 9)::INT - 1, 0), count(*)::INT - 1) / (count(*) - 1) ELSE 0 END, 6) AS step_pos FROM conversations GROUP BY conv_id")
def error_step(spark, sf):
    chunks = load_table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list("text").alias("c"))
    step = X.error_step((F.col("conv_id") % 9).cast("string"), F.col("c"))
    return rounded(chunks.select("conv_id", step.alias("step"), F.when(F.size("c") > 1, step / (F.size("c") - 1)).otherwise(0.0).alias("step_pos")))


_SPELLED = """SELECT 'returnflag' AS source, l_returnflag AS v FROM lineitem UNION ALL SELECT 'linestatus', ' ' || l_linestatus FROM lineitem UNION ALL SELECT 'orderstatus', lower(o_orderstatus) FROM orders UNION ALL SELECT 'quality', quality::VARCHAR FROM labels
UNION ALL SELECT 'prop', json_extract_string(props, '$.k') FROM events UNION ALL SELECT 'word', regexp_extract(text, '^\\S*') || ' ' FROM conversations"""


@query("q_parse_bool", f"SELECT source, v, CASE WHEN lower(trim(v)) IN ('true','t','1','yes','y','success','passed','won') THEN true WHEN lower(trim(v)) IN ('false','f','0','no','n','fail','failed','lost') THEN false END AS parsed, count(*) AS n FROM ({_SPELLED}) GROUP BY source, v")
def parse_bool(spark, sf):
    """Truth values of flags, states, labels, properties and first words, by their spelling."""
    spelled = {
        "returnflag": ("lineitem", F.col("l_returnflag")), "linestatus": ("lineitem", F.concat(F.lit(" "), "l_linestatus")), "orderstatus": ("orders", F.lower("o_orderstatus")), "quality": ("labels", F.col("quality").cast("string")),
        "prop": ("events", F.get_json_object("props", "$.k")), "word": ("conversations", F.concat(F.regexp_extract("text", r"^\S*", 0), F.lit(" "))),
    }
    out = None
    for source, (table, value) in spelled.items():
        counts = load_table(spark, sf, table).groupBy(F.lit(source).alias("source"), value.alias("v")).agg(F.count("*").alias("n"))
        out = counts if out is None else out.unionByName(counts)
    return out.select("source", "v", X.parse_bool(F.col("v")).alias("parsed"), "n")


@query("q_fuzzy_numeric_match", "WITH p AS (SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_retailprice AS x, b.p_retailprice AS y FROM part a JOIN part b ON a.p_size = b.p_size AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey) SELECT a, b, (x = 0 AND y = 0) OR (y <> 0 AND (abs(x - y) <= 0.02::DOUBLE * abs(y) OR abs(x * 100 - y) <= 0.02::DOUBLE * abs(y) OR abs(x * 0.01::DOUBLE - y) <= 0.02::DOUBLE * abs(y))) AS matched FROM p")
def fuzzy_numeric_match(spark, sf):
    part = load_table(spark, sf, "part").select("p_partkey", "p_size", "p_brand", X.numeric_value(F.col("p_retailprice").cast("string")).alias("v"))
    left, right = H.paired(part, ["p_size", "p_brand"], "p_partkey")
    b = right.select("p_size", "p_brand", "tile", F.col("p_partkey").alias("b"), F.col("v").alias("w"))
    return left.withColumnRenamed("p_partkey", "a").join(b, ["p_size", "p_brand", "tile"]).where("a < b").select("a", "b", X.numbers_match(F.col("v"), F.col("w")).alias("matched"))


@query("q_best_fuzzy_match")
def best_fuzzy_match(spark, sf):
    part = load_table(spark, sf, "part")
    e = part.select(F.col("p_brand").alias("paper"), F.col("p_partkey").alias("x"), F.col("p_type").alias("dataset"), F.lit("Accuracy").alias("metric"), F.col("p_retailprice").cast("string").alias("value"))
    t = part.select(F.col("p_brand").alias("paper"), F.col("p_partkey").alias("position"), F.col("p_type").alias("dataset"), F.lit("acc").alias("metric"), (F.col("p_retailprice") / 100).cast("string").alias("value"))
    return H.best_fuzzy_match(e, t, "paper", "x", "position")


@query("q_substring_match", "WITH n AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS n, trim(regexp_replace(lower(p_type), '\\s+', ' ', 'g')) AS t FROM part) SELECT p_partkey, n <> '' AND t <> '' AND (contains(n, t) OR contains(t, n)) AS matched FROM n")
def substring_match(spark, sf):
    return load_table(spark, sf, "part").select("p_partkey", X.substring_match(F.col("p_name"), F.col("p_type")).alias("matched"))


@query("q_similarity_ratio")
def similarity(spark, sf):
    part = load_table(spark, sf, "part")
    return rounded(part.select("p_partkey", T.similarity_ratio("p_name", "p_type").alias("ratio"), T.rouge_l("p_name", "p_type").alias("rouge_l"), T.vote_answer("p_name").alias("answer")))


# Models and ratings
@query("q_partial_corr")
def partial_corr(spark, sf):
    rows = levelled_events(spark, sf).select("user_id", "value", F.col("lvl").cast("double").alias("lvl"), F.hour("ts").cast("double").alias("hour"))
    return rounded(M.partial_spearman(rows, "user_id", "value", "lvl", ["hour"]))


def doc_features(spark, sf) -> DataFrame:
    rows = labelled(spark, sf)
    m = X.surface_features(F.col("text"))
    exclaims = F.regexp_count("text", F.lit("!!")) / F.greatest(F.col("words"), F.lit(1))
    bars = F.regexp_count("text", F.lit(r"\|")) / F.greatest(F.col("words"), F.lit(1))
    distinct = F.size(F.array_distinct(X.words(F.col("text")))) / F.greatest(F.col("words"), F.lit(1))
    return rows.select("doc_id", "quality", F.col("words").cast("double").alias("words"), m["entity_density"].alias("entity_density"), exclaims.alias("exclaims"), bars.alias("bars"), distinct.alias("distinct_share"))


_COLUMNS = ["entity_density", "exclaims", "bars", "distinct_share"]


@query("q_logreg_oof")
def logreg_oof(spark, sf):
    folds = P.stratified_folds(doc_features(spark, sf), "quality", "doc_id", order=[F.col("doc_id")])
    return rounded(M.out_of_fold(folds.cache(), "doc_id", "quality", _COLUMNS))


@query("q_oof_scores")
def oof_scores(spark, sf):
    out = logreg_oof(spark, sf)
    return rounded(S.auc(out, "quality", "prob"))


@query("q_residualized")
def residualized(spark, sf):
    folds = P.stratified_folds(doc_features(spark, sf), "quality", "doc_id", order=[F.col("doc_id")]).cache()
    return rounded(S.auc(M.out_of_fold(folds, "doc_id", "quality", _COLUMNS, controls=["words"]), "quality", "prob"))


@query("q_logreg_probe")
def logreg_probe(spark, sf):
    v = load_table(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") % 3).alias("lvl"))
    out = M.probe(v.where("vec_id % 5 <> 0"), v.where("vec_id % 5 = 0"), "lvl", "embedding")
    return rounded(S.averaged_metrics(S.class_metrics(out.select("lvl", F.col("prediction").cast("int").alias("p")), "lvl", "p")))


@query("q_boosted_trees")
def boosted(spark, sf):
    rows = doc_features(spark, sf)
    train, test = rows.where("doc_id % 5 <> 0"), rows.where("doc_id % 5 = 0")
    scaler = M.Scaler(train, _COLUMNS)
    out = M.boosted_trees(scaler.apply(train), "quality", trees=10).transform(scaler.apply(test))
    return out.agg(F.count("*").alias("n"), F.round(F.avg((F.col("prediction") == F.col("quality")).cast("double")), 6).alias("accuracy"))


@query("q_kmeans")
def kmeans(spark, sf):
    from ..operators import traces

    cells = traces.hard_transitions(levelled_events(spark, sf), ["user_id"], ["ts", "event_id"], "lvl")
    out, k = M.clusters(cells, [c for c in cells.columns if c.startswith("t_")], (2, 3))
    return out.groupBy("cluster").agg(F.count("*").alias("n"), F.lit(k).alias("k"))


@query("q_explained_variance")
def explained_variance(spark, sf):
    shares = M.explained_variance(load_table(spark, sf, "embeddings"), "embedding", 5)
    return spark.createDataFrame([(i, round(v, 6)) for i, v in enumerate(shares)], "component int, share double")


@query("q_majority_baseline", "WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT arg_max(lang, n) AS guess, round(max(n) / sum(n), 6) AS accuracy FROM c")
def majority_baseline(spark, sf):
    return rounded(M.majority_baseline(load_table(spark, sf, "documents"), "lang"))


@query("q_ratings")
def ratings(spark, sf):
    matches = R.run_tournaments(load_table(spark, sf, "conversations"), R.longer, 20, "conv_id", "turn", "text")
    return rounded(R.rate_matches(matches, "conv_id"))


@query("q_active_pairs")
def active_pairs(spark, sf):
    return R.run_tournaments(load_table(spark, sf, "conversations"), R.longer, 20, "conv_id", "turn", "text")


@query("q_anchor_fit")
def anchor_fit(spark, sf):
    rated = R.rate_matches(R.run_tournaments(load_table(spark, sf, "conversations"), R.longer, 40, "conv_id", "turn", "text"), "conv_id")
    turns = load_table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("part"), F.char_length("text").alias("chars"))
    return rounded(S.spearman(rated.join(turns, ["conv_id", "part"]), "mu", "chars"))


@query("q_usable_features")
def usable_features(spark, sf):
    rows = docs(spark, sf).select("n_chars", "words", F.col("words").alias("words_again"), F.lit(1).alias("constant"))
    return spark.createDataFrame([(c,) for c in H.usable_features(rows, rows.columns)], "column string")
