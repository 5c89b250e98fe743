"""Queries over records, responses and summaries."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import detectors as D
from ..operators import messages as M
from ..operators import models
from ..operators import retrieval as R
from ..operators import sampling as P
from ..operators import statistics as S
from ..operators import tiles
from ..operators import traces as T
from ..sources import load_table, stored
from .attempt_queries import _ATT, attempts
from .registry import query
from .retrieval_queries import _CAND, _PAIRS, _vector_sides, pair_f1, retrieved
from .text_queries import _HEADED, DOCS, docs, headed, labelled
from .trace_queries import EV, levelled_events, rounded


@query("q_agent_messages", "SELECT conv_id, count(*) AS n, md5(string_agg(role || ':' || text, '|' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def agent_messages(spark, sf):
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    records = load_table(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("m"))
    shape = F.col("conv_id") % 3
    record = F.when(shape == 0, F.to_json(F.struct(F.col("m").alias("messages")))).when(shape == 1, F.to_json(F.struct(F.col("m").alias("chat_history")))).otherwise(F.to_json(F.struct(F.transform("m", lambda m: F.struct(F.array(m).alias("messages"))).alias("steps"))))
    parsed = records.select("conv_id", M.agent_messages(record).alias("m"))
    return parsed.select("conv_id", F.size("m").cast("bigint").alias("n"), F.md5(F.array_join(F.transform("m", lambda m: F.concat_ws(":", m["role"], m["content"])), "|")).alias("digest"))


@query("q_step_chunks", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'Tool calls: ' || event_type || '(' || user_id || ') | tool()' ELSE event_type || CASE WHEN value > 50 THEN chr(10) || 'Tool calls: ' || event_type || '(' || user_id || ') | tool()' ELSE '' END END AS chunk FROM events")
def step_chunks(spark, sf):
    e = load_table(spark, sf, "events")
    calls = F.array(F.struct(F.col("event_type").alias("name"), F.col("user_id").cast("string").alias("arguments")), F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments")))
    some = (F.col("event_type") == "error") | (F.col("value") > 50)
    content = F.when(F.col("event_type") == "error", F.lit(" \n")).otherwise(F.col("event_type"))
    return e.select("event_id", M.step_chunk(content, F.when(some, calls)).alias("chunk"))


# Responses made of the lines of each turn: as marked steps, as a numbered list, with blank lines between, or as they are.
_STRIP = lambda x: f"regexp_replace({x}, '^[ \\t\\n\\f\\r]+|[ \\t\\n\\f\\r]+$', '', 'g')"
_CUT = lambda x: f"list_filter(list_transform({x}, lambda p: {_STRIP('p')}), lambda p: p <> '')"
_ANSWERED = """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Think. ' || array_to_string(list_transform(ls, lambda l, i: 'sTep ' || i || (CASE WHEN i % 2 = 0 THEN ' : ' ELSE '. ' END) || l), chr(10)) || CASE WHEN conv_id % 2 = 0 THEN chr(10) || 'ANSWER: ' || ls[1] || chr(10) ELSE '' END
WHEN 1 THEN array_to_string(list_transform(ls, lambda l, i: i || (CASE WHEN i % 2 = 0 THEN ') ' ELSE '. ' END) || l), chr(10)) WHEN 2 THEN array_to_string(ls, chr(10) || chr(10)) ELSE text END AS t FROM (SELECT *, string_split(text, chr(10)) AS ls FROM conversations)"""


def responses(spark, sf):
    lines = F.split("text", "\n")
    mark = lambda odd, even: lambda line, i: F.concat((i + 1).cast("string"), F.when((i + 1) % 2 == 0, even).otherwise(odd), line)
    steps = F.transform(lines, lambda line, i: F.concat(F.lit("sTep "), mark(". ", " : ")(line, i)))
    answer = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("\nANSWER: "), F.get(lines, F.lit(0)), F.lit("\n"))).otherwise("")
    marked = F.concat(F.lit("Think. "), F.array_join(steps, "\n"), answer)
    numbered = F.array_join(F.transform(lines, mark(". ", ") ")), "\n")
    kind = F.col("turn") % 4
    return load_table(spark, sf, "conversations").select("conv_id", "turn", F.when(kind == 0, marked).when(kind == 1, numbered).when(kind == 2, F.array_join(lines, "\n\n")).otherwise(F.col("text")).alias("t"))


@query(
    "q_reasoning_steps",
    rf"""WITH r AS ({_ANSWERED}), b AS (SELECT conv_id, turn, t, contains(t, 'ANSWER:') AS has, {_STRIP("CASE WHEN contains(t, 'ANSWER:') THEN regexp_extract(t, '(?s)^(.*?)ANSWER:', 1) ELSE t END")} AS b FROM r),
p AS (SELECT *, regexp_split_to_array(b, '(?i)Step\s+\d+\s*[:.]') AS m, {_CUT(r"regexp_split_to_array(b, '\n\s*\d+[.)]\s+')")} AS numbered, {_CUT("string_split(b, chr(10) || chr(10))")} AS blank FROM b),
q AS (SELECT *, {_CUT("CASE WHEN len(m) > 1 THEN m[2:] ELSE m END")} AS marked FROM p)
SELECT conv_id, turn, array_to_string(CASE WHEN len(marked) > 1 THEN marked WHEN len(numbered) > 1 THEN numbered ELSE blank END, '|') AS steps, CASE WHEN has THEN {_STRIP(r"regexp_extract(t, '(?s)ANSWER:\s*(.*)', 1)")} ELSE {_STRIP("string_split(b, chr(10))[-1]")} END AS answer FROM q""",
)
def reasoning_steps(spark, sf):
    steps, answer = M.reasoning_steps(F.col("t"))
    return responses(spark, sf).select("conv_id", "turn", F.array_join(steps, "|").alias("steps"), answer.alias("answer"))


# Records of a response: the first words of a conversation's turns, fenced, wrapped, alone, within prose, or none at all.
_REPLIED = """SELECT conv_id, CASE conv_id % 6 WHEN 0 THEN '```json' || chr(10) || j || chr(10) || '```' WHEN 1 THEN '{"results": ' || j || '}' WHEN 2 THEN '{"a": "' || w[1] || '"}' WHEN 3 THEN 'Sure: ' || j || ' done' WHEN 4 THEN 'nothing in [' || w[1] || ']' ELSE '{"data": []}' END AS t
FROM (SELECT conv_id, list(w ORDER BY turn) AS w, '[' || string_agg('{"a": "' || w || '"}', ', ' ORDER BY turn) || ']' AS j FROM (SELECT conv_id, turn, regexp_extract(text, '^[^\\s"\\\\]*') AS w FROM conversations) GROUP BY conv_id)"""


@query(
    "q_fenced_json",
    rf"""WITH r AS ({_REPLIED}), f AS (SELECT conv_id, t, regexp_extract(t, '(\[.*\])', 1, 's') AS l FROM r), o AS (SELECT conv_id, CASE WHEN json_valid(l) AND json_type(l) = 'ARRAY' THEN json_extract_string(l, '$[*].a') WHEN json_valid(t) THEN [json_extract_string(t, '$.a')] ELSE [] END AS v FROM f)
SELECT conv_id, array_to_string(v, ',') AS vals FROM o""",
)
def fenced_json(spark, sf):
    word = F.regexp_extract("text", r'^[^\s"\\]*', 0)
    turns = load_table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", word.alias("w")))), lambda s: s["w"]).alias("w"))
    one = lambda w: F.concat(F.lit('{"a": "'), w, F.lit('"}'))
    listed = F.concat(F.lit("["), F.array_join(F.transform("w", one), ", "), F.lit("]"))
    first, kind = F.get("w", F.lit(0)), F.col("conv_id") % 6
    text = F.when(kind == 0, F.concat(F.lit("```json\n"), listed, F.lit("\n```"))).when(kind == 1, F.concat(F.lit('{"results": '), listed, F.lit("}"))).when(kind == 2, one(first))
    text = text.when(kind == 3, F.concat(F.lit("Sure: "), listed, F.lit(" done"))).when(kind == 4, F.concat(F.lit("nothing in ["), first, F.lit("]"))).otherwise('{"data": []}')
    rows = F.transform(M.fenced_rows(text, "struct<a: string>"), lambda r: r["a"])
    return turns.select("conv_id", F.array_join(rows, ",").alias("vals"))


@query("q_usage", "SELECT user_id, count(*) * 10 AS input_tokens, CASE WHEN user_id % 2 = 0 THEN count(*) END AS reasoning_tokens, CASE user_id % 3 WHEN 0 THEN 'stop' WHEN 1 THEN 'max_output_tokens' ELSE 'incomplete' END AS finish_reason FROM events GROUP BY user_id")
def usage(spark, sf):
    counts = load_table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    details = F.when(F.col("user_id") % 2 == 0, F.struct(F.col("n").alias("reasoning_tokens")))
    reason = F.when(F.col("user_id") % 3 == 1, F.struct(F.lit("max_output_tokens").alias("reason")))
    response = F.to_json(F.struct(F.when(F.col("user_id") % 3 == 0, "completed").otherwise("incomplete").alias("status"), F.struct((F.col("n") * 10).alias("input_tokens"), details.alias("output_tokens_details")).alias("usage"), reason.alias("incomplete_details")))
    found = M.usage(F.col("response"))
    return counts.withColumn("response", response).select("user_id", *(found[k].alias(k) for k in ("input_tokens", "reasoning_tokens", "finish_reason")))


@query("q_critical_error", "SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'memory' ELSE 'planning' END AS module, CASE WHEN user_id % 2 = 0 THEN 'loss' ELSE 'loop' END AS error_type FROM (SELECT DISTINCT user_id FROM events)")
def critical_error(spark, sf):
    users = load_table(spark, sf, "events").select("user_id").distinct()
    module = F.when(F.col("user_id") % 2 == 0, F.lit("memory"))
    notes = F.array(F.lit('{"step": "1", "planning": {"failure_type": "loop", "reasoning": "r"}, "memory": {"failure_type": "loss"}}'))
    return users.select("user_id", M.critical_error(module, notes).alias("e")).select("user_id", "e.module", "e.error_type")


@query("q_drift_features", f"WITH ev AS ({EV}) SELECT event_id, round((3 * abs(1 - lvl) + 2 * abs(2 - lvl)) / 5, 6) AS drift_mean, greatest(abs(1 - lvl), abs(2 - lvl))::INT AS drift_max, round(-({' + '.join(f'(a{k} + 1e-10::DOUBLE) / (a0 + a1 + a2 + 3e-10::DOUBLE) * ln((a{k} + 1e-10::DOUBLE) / (a0 + a1 + a2 + 3e-10::DOUBLE))' for k in range(3))}), 6) AS level_entropy FROM (SELECT *, 0.5::DOUBLE AS a0, 0.25::DOUBLE AS a1, lvl / 8 AS a2 FROM ev)")
def drift_features(spark, sf):
    f = M.drift_features(F.col("lvl"), [F.lit(0.5), F.lit(0.25), F.col("lvl") / 8])
    return rounded(levelled_events(spark, sf).select("event_id", *(f[k].alias(k) for k in ("drift_mean", "drift_max", "level_entropy"))))


@query("q_first_positive", "WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events), h AS (SELECT user_id, min(step) FILTER (WHERE value > 90) AS first_step, count(*) AS n FROM s GROUP BY user_id) SELECT user_id, first_step::BIGINT AS first_step, coalesce(first_step + 1, n)::BIGINT AS judged FROM h")
def first_positive(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = load_table(spark, sf, "events").select("user_id", (F.row_number().over(w) - 1).cast("bigint").alias("step"), (F.col("value") > 90).alias("flag"))
    return M.first_positive(steps, ["user_id"], "step", "flag")


@query("q_predicted_step", "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
def predicted_step(spark, sf):
    return M.predicted_step(load_table(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value")


@query("q_relevant_sections", f"SELECT doc_id, lower(section_name) IN ('abstract', 'title') OR list_bool_or(list_transform({M.RESULT_SECTIONS!r}, lambda k: contains(lower(section_name), k))) AS relevant FROM ({_HEADED})")
def relevant_sections(spark, sf):
    return headed(spark, sf).select("doc_id", M.relevant_section(F.col("section_name")).alias("relevant"))


@query("q_relevant_fulltext", f"WITH d AS (SELECT doc_id, section_name, text FROM ({_HEADED}) JOIN documents USING (doc_id)) SELECT doc_id // 10 AS paper, md5(string_agg('[' || section_name || '] ' || text, chr(10) || chr(10) ORDER BY doc_id)) AS digest, count(*) AS sections FROM d WHERE lower(section_name) IN ('abstract', 'title') OR list_bool_or(list_transform({M.RESULT_SECTIONS!r}, lambda k: contains(lower(section_name), k))) GROUP BY 1")
def relevant_fulltext(spark, sf):
    """The sections of each paper that are likely to hold results, as one text; a paper is ten documents, so a row is bounded by them."""
    sections = headed(spark, sf).join(load_table(spark, sf, "documents").select("doc_id", "text"), "doc_id").where(M.relevant_section(F.col("section_name")))
    part = F.concat(F.lit("["), "section_name", F.lit("] "), "text")
    whole = sections.groupBy(F.floor(F.col("doc_id") / 10).alias("paper")).agg(F.array_sort(F.collect_list(F.struct("doc_id", part.alias("part")))).alias("parts"))
    return whole.select("paper", F.md5(F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n")).alias("digest"), F.size("parts").cast("bigint").alias("sections"))


@query("q_token_cost", f"{_PAIRS}, w AS (SELECT query_id, doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM para) SELECT query_id, sum(n)::BIGINT AS tokens FROM ret JOIN w USING (query_id, doc_id) GROUP BY query_id")
def token_cost(spark, sf):
    from .retrieval_queries import paragraphs

    sizes = paragraphs(spark, sf).select("query_id", "doc_id", X.word_count(F.col("text")).alias("n"))
    return retrieved(spark, sf).join(sizes, ["query_id", "doc_id"]).groupBy("query_id").agg(F.sum("n").alias("tokens"))


@query("q_question_levels", f"{_PAIRS}, b AS (SELECT query_id, gold_id, arg_min(doc_id, (-round(f1, 9), doc_id)) AS doc_id, max(round(f1, 9)) AS f1 FROM pairs GROUP BY ALL) SELECT query_id, gold_id, doc_id, round(f1, 6) AS f1 FROM b WHERE f1 > 0.5")
def question_levels(spark, sf):
    scored = pair_f1(spark, sf).withColumn("f1", F.round("f1", 9))
    best = scored.groupBy("query_id", "gold_id").agg(F.min_by("doc_id", F.struct((-F.col("f1")).alias("f"), "doc_id")).alias("doc_id"), F.max("f1").alias("f1"))
    return rounded(best.where("f1 > 0.5"))


@query("q_retrieval_summary", f"{_PAIRS}, k AS (SELECT k, query_id, score FROM ret, (VALUES (1), (5), (10)) v(k) WHERE rank <= k) SELECT k, query_id, count(*) AS n, round(avg(score), 6) AS mean_score, round(stddev_pop(score), 6) AS std_score FROM k GROUP BY GROUPING SETS ((k), (k, query_id))")
def retrieval_summary(spark, sf):
    swept = R.k_sweep(retrieved(spark, sf), (1, 5, 10))
    return rounded(swept.groupingSets([["k"], ["k", "query_id"]], "k", "query_id").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score")))


@query("q_anchor_pairs", "SELECT p.p_partkey AS chunk, a.tier, abs(p.p_size - a.size)::INT AS distance FROM part p, (VALUES (1, 5), (2, 25), (3, 45)) a(tier, size)")
def anchor_pairs(spark, sf):
    # The anchors are a literal list.
    anchors = spark.createDataFrame([(1, 5), (2, 25), (3, 45)], "tier int, size int")
    return load_table(spark, sf, "part").crossJoin(F.broadcast(anchors)).select(F.col("p_partkey").alias("chunk"), "tier", F.abs(F.col("p_size") - F.col("size")).alias("distance"))


@query("q_label_alignment", "SELECT count(*) FILTER (WHERE quality = toxic) AS same, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS only_first, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS only_second, round(avg((quality = toxic)::INT), 6) AS agreement FROM labels")
def label_alignment(spark, sf):
    q, t = F.col("quality"), F.col("toxic")
    return rounded(load_table(spark, sf, "labels").agg(F.count_if(q == t).alias("same"), F.count_if((q == 1) & (t == 0)).alias("only_first"), F.count_if((q == 0) & (t == 1)).alias("only_second"), F.avg((q == t).cast("double")).alias("agreement")))


@query("q_median_features", f"SELECT lang, count(*) AS n, round(avg(words), 6) AS mean_words, round(quantile_cont(words, 0.5), 6) AS median_words FROM ({DOCS}) GROUP BY lang")
def median_features(spark, sf):
    rows = docs(spark, sf)
    sums = rows.groupBy("lang").agg(F.count("*").alias("n"), F.avg("words").alias("mean_words"))
    return rounded(sums.join(S.quantile(rows, "words", 0.5, ["lang"]).withColumnRenamed("quantile", "median_words"), "lang"))


@query("q_diversity_split", f"WITH d AS (SELECT * FROM ({DOCS}) WHERE lang <> 'es'), m AS (SELECT quantile_cont(words, 0.5) AS m FROM d) SELECT CASE WHEN words <= m THEN 'low' ELSE 'high' END AS half, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM d, m GROUP BY 1")
def diversity_split(spark, sf):
    rows = docs(spark, sf).where("lang <> 'es'")
    middle = S.quantile(rows, "words", 0.5).withColumnRenamed("quantile", "m")  # one row
    return rounded(rows.crossJoin(F.broadcast(middle)).groupBy(F.when(F.col("words") <= F.col("m"), "low").otherwise("high").alias("half")).agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean_chars")))


@query("q_class_feasibility", "WITH c AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS positives, count(*) FILTER (WHERE quality = 0) AS negatives FROM documents JOIN labels USING (doc_id) GROUP BY lang) SELECT lang, positives, negatives, least(5, positives, negatives)::BIGINT AS folds, CASE WHEN n < 20 THEN 'too_few' WHEN least(positives, negatives) < 2 THEN 'one_class' ELSE 'ok' END AS status FROM c")
def class_feasibility(spark, sf):
    counts = labelled(spark, sf).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("positives"), F.count_if(F.col("quality") == 0).alias("negatives"))
    least = F.least("positives", "negatives")
    return counts.select("lang", "positives", "negatives", F.least(F.lit(5).cast("bigint"), "positives", "negatives").alias("folds"), F.when(F.col("n") < 20, "too_few").when(least < 2, "one_class").otherwise("ok").alias("status"))


@query("q_model_wins", f"{_ATT}, p AS (SELECT run_order AS run, round(avg(answered::INT), 6) AS a, round(avg(correct::INT), 6) AS b FROM att GROUP BY run_order), j AS (SELECT run, round(a - b, 6) AS difference, CASE WHEN a - b >= 0.03 THEN 'win' WHEN a - b <= -0.03 THEN 'regress' ELSE 'inconclusive' END AS verdict FROM p) SELECT run, difference, verdict, count(*) FILTER (WHERE verdict = 'win') OVER () >= 3 AS carried FROM j")
def model_wins(spark, sf):
    per = attempts(spark, sf).groupBy(F.col("run_order").alias("run")).agg(F.round(F.avg(F.col("answered").cast("double")), 6).alias("a"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("b"))
    return rounded(M.model_wins(per.unpivot(["run"], ["a", "b"], "model", "v"), "run", "model", "v", "a", "b"))


@query(
    "q_aligned_comparison",
    f"""{_ATT}, a AS (SELECT id, answered::INT AS y FROM att WHERE run_order = 0), b AS (SELECT id, correct::INT AS y FROM att WHERE run_order = 1), j AS (SELECT a.id AS x, b.id AS z, a.y AS p, b.y AS q FROM a FULL JOIN b USING (id))
SELECT count(*) FILTER (WHERE x IS NOT NULL AND z IS NOT NULL) AS n, count(*) FILTER (WHERE z IS NULL) AS only_left, count(*) FILTER (WHERE x IS NULL) AS only_right, round(avg(p) FILTER (WHERE z IS NOT NULL), 6) AS "left", round(avg(q) FILTER (WHERE x IS NOT NULL), 6) AS "right", round(avg(p - q), 6) AS difference FROM j""",
)
def aligned_comparison(spark, sf):
    """Two runs compared on the problems that both have; those of one run only are counted."""
    rows = attempts(spark, sf)
    a = rows.where("run_order = 0").select("id", F.col("answered").cast("int").alias("p"))
    b = rows.where("run_order = 1").select("id", F.col("correct").cast("int").alias("q"))
    both = a.join(b, "id", "full")
    inner = F.col("p").isNotNull() & F.col("q").isNotNull()
    return rounded(both.agg(F.count_if(inner).alias("n"), F.count_if(F.col("q").isNull()).alias("only_left"), F.count_if(F.col("p").isNull()).alias("only_right"), F.avg(F.when(inner, F.col("p"))).alias("left"), F.avg(F.when(inner, F.col("q"))).alias("right"), F.avg(F.col("p") - F.col("q")).alias("difference")))


@query("q_univariate_signal", f"WITH l AS (SELECT 'words' AS feature, quality, words::DOUBLE AS x FROM ({DOCS}) JOIN labels USING (doc_id) UNION ALL SELECT 'n_chars', quality, n_chars FROM ({DOCS}) JOIN labels USING (doc_id)), r AS (SELECT feature, quality, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0::DOUBLE AS r FROM l), s AS (SELECT feature, count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality = 0) AS n, sum(r) FILTER (WHERE quality = 1) AS s FROM r GROUP BY feature), a AS (SELECT feature, (s - p * (p + 1) / 2) / (p * n) AS auc FROM s) SELECT feature, round(greatest(auc, 1 - auc), 6) AS signal, CASE WHEN auc >= 0.5 THEN 'higher' ELSE 'lower' END AS direction FROM a")
def univariate_signal(spark, sf):
    long = labelled(spark, sf).select("quality", F.col("words").cast("double").alias("words"), F.col("n_chars").cast("double").alias("n_chars")).unpivot(["quality"], ["words", "n_chars"], "feature", "x")
    a = S.auc(long, "quality", "x", ["feature"])
    return rounded(a.select("feature", F.greatest(F.col("auc"), 1 - F.col("auc")).alias("signal"), F.when(F.col("auc") >= 0.5, "higher").otherwise("lower").alias("direction")))


@query("q_ols", f"SELECT round(regr_slope(n_chars, words), 4) AS slope, round(regr_r2(n_chars, words), 6) AS r2 FROM ({DOCS})")
def ols(spark, sf):
    rows = VectorAssembler(inputCols=["w"], outputCol="x").transform(docs(spark, sf).select(F.col("words").cast("double").alias("w"), F.col("n_chars").cast("double").alias("y")))
    fit = LinearRegression(labelCol="y", featuresCol="x", regParam=0.0).fit(rows)
    return spark.createDataFrame([(round(float(fit.coefficients[0]), 4), round(float(fit.summary.r2), 6))], "slope double, r2 double")


@query(
    "q_capture_ratio",
    f"""WITH l AS (SELECT lang, quality, words::DOUBLE AS a, n_chars / (words + 1) AS b FROM ({DOCS}) JOIN labels USING (doc_id)), r AS (SELECT lang, quality, rank() OVER (PARTITION BY lang ORDER BY a) + (count(*) OVER (PARTITION BY lang, a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY lang ORDER BY b) + (count(*) OVER (PARTITION BY lang, b) - 1) / 2.0::DOUBLE AS rb FROM l),
s AS (SELECT lang, sum(quality) AS p, count(*) - sum(quality) AS n, sum(ra) FILTER (WHERE quality = 1) AS sa, sum(rb) FILTER (WHERE quality = 1) AS sb FROM r GROUP BY lang), u AS (SELECT lang, CASE WHEN p > 0 AND n > 0 THEN (sa - p * (p + 1) / 2) / (p * n) END AS part, CASE WHEN p > 0 AND n > 0 THEN (sb - p * (p + 1) / 2) / (p * n) END AS "full" FROM s)
SELECT lang, round(part, 6) AS part, round("full", 6) AS "full", round(CASE WHEN "full" > 0.5 THEN (part - 0.5) / ("full" - 0.5) END, 6) AS ratio FROM u""",
)
def capture_ratio(spark, sf):
    """How much of the lift of the mean word length the number of words keeps, per language."""
    rows = labelled(spark, sf).select("lang", "quality", F.col("words").cast("double").alias("a"), (F.col("n_chars") / (F.col("words") + 1)).alias("b"))
    both = S.auc(rows, "quality", "a", ["lang"]).select("lang", F.col("auc").alias("part")).join(S.auc(rows, "quality", "b", ["lang"]).select("lang", F.col("auc").alias("full")), "lang")
    return rounded(both.select("lang", "part", "full", D.capture_ratio(F.col("part"), F.col("full")).alias("ratio")))


@query("q_paired_conditions", f"{_CAND}, m AS (SELECT query_id, avg(cosine) FILTER (WHERE level = 'macro') AS a, avg(cosine) FILTER (WHERE level = 'micro') AS b FROM c GROUP BY query_id) SELECT query_id, round(b - a, 6) + 0.0 AS difference FROM m WHERE a IS NOT NULL AND b IS NOT NULL")
def paired_conditions(spark, sf):
    """By sums of unit vectors; a difference whose sixth digit might turn on the rounding of cosines is taken from all pairs of its query."""

    def differences(means):
        sides = means.groupBy("query_id").pivot("level", ["macro", "micro"]).agg(F.first("mean"))
        return sides.where("macro is not null and micro is not null").select("query_id", (F.col("micro") - F.col("macro")).alias("difference"))

    queries, rows = _vector_sides(spark, sf)
    found = stored(differences(tiles.level_means_by_sums(queries, rows)), "paired")
    last = F.col("difference") * 1e6
    unsure = F.abs(last - F.floor(last) - 0.5) <= 1.1 * 10.0 ** (6 - tiles.DIGITS)
    again = found.where(unsure).select(F.col("query_id").alias("id"))
    if again.isEmpty():
        return rounded(found)
    exact = differences(tiles.level_means(queries.join(again, "id", "left_semi"), rows))
    return rounded(found.where(~unsure).unionByName(exact))


@query("q_group_fold_probe")
def group_fold_probe(spark, sf):
    rows = P.group_folds(labelled(spark, sf).select("doc_id", "source", "quality", F.col("words").cast("double").alias("words"), F.col("n_chars").cast("double").alias("chars")), "source", 2).cache()
    return rounded(S.auc(models.out_of_fold(rows, "doc_id", "quality", ["words", "chars"]), "quality", "prob"))


@query("q_failure_location")
def failure_location(spark, sf):
    """Per-step classifier: steps of a user, the first value above 95 is the error; out-of-fold by user, then the likeliest step."""
    steps = T.step_features(levelled_events(spark, sf), ["user_id"], ["ts", "event_id"], "value")
    first = steps.where("value > 95").groupBy("user_id").agg(F.min("step_index").alias("error"))
    rows = steps.join(first, "user_id").withColumn("target", (F.col("step_index") == F.col("error")).cast("int"))
    folds = P.group_folds(rows, "user_id", 2).cache()
    probs = models.out_of_fold(folds, "event_id", "target", ["centred", "delta_prev", "delta_next", "fall_from_peak", "step_pos"])
    best = M.predicted_step(probs.join(folds.select("event_id", "user_id", "step_index", "error"), "event_id"), "user_id", "step_index", "prob")
    return best.agg(F.count("*").alias("traces"), F.round(F.avg((F.col("step_index") == F.col("error")).cast("double")), 6).alias("exact"), F.round(F.avg(F.abs(F.col("step_index") - F.col("error"))), 6).alias("mean_distance"))
