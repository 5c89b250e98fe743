"""Queries over single functions and over sources: parsing, ids, records, rubrics, and what is written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources
from ..functions import text as X
from ..operators import labeling as L
from ..operators import shaping as H
from ..sources import load_table
from ..sources import tables as files
from .registry import query
from .text_queries import _SENT, DOCS, W, docs
from .trace_queries import rounded

# Texts with the marks that a parser looks for are made of table columns.


@query("q_arxiv_ids", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN lpad((page_id % 10000)::VARCHAR, 4, '0') || '.' || lpad((page_id % 100000)::VARCHAR, 5, '0') ELSE 'cs-lg/' || lpad((page_id % 10000000)::VARCHAR, 7, '0') END AS paper FROM pages WHERE page_id % 3 < 2")
def arxiv_ids(spark, sf):
    pages = load_table(spark, sf, "pages").select("page_id", "url")
    number = lambda most, width: F.lpad((F.col("page_id") % most).cast("string"), width, "0")
    new = F.concat(F.lit("see https://arxiv.org/abs/"), number(10_000, 4), F.lit("."), number(100_000, 5), F.lit("v2"))
    old = F.concat(F.lit("https://arxiv.org/pdf/cs-lg/"), number(10_000_000, 7))
    cited = F.when(F.col("page_id") % 3 == 0, new).when(F.col("page_id") % 3 == 1, old).otherwise(F.col("url"))
    return pages.select("page_id", X.arxiv_id(cited).alias("paper")).where("paper is not null")


@query("q_list_filter", "SELECT source, count(*) AS n FROM documents WHERE lang IN ('en', 'fr') GROUP BY source")
def list_filter(spark, sf):
    rows = load_table(spark, sf, "documents").where(H.isin_or_all(F.col("lang"), ["en", "fr"]) & H.isin_or_all(F.col("source"), None))
    return rows.groupBy("source").agg(F.count("*").alias("n"))


@query("q_first_filled", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN user_id::VARCHAR END AS v FROM events")
def first_filled(spark, sf):
    turn = F.col("event_id") % 3
    values = (F.when(turn == 0, F.col("event_type")).otherwise("  "), F.when(turn == 1, F.col("user_id").cast("string")), F.lit(""))
    return load_table(spark, sf, "events").select("event_id", X.first_filled(*values).alias("v"))


@query("q_first_wrong_step", "SELECT conv_id, conv_id % 5 = 0 AS is_correct, CASE WHEN conv_id % 5 <> 0 THEN conv_id % 5 - 1 END AS error_step FROM (SELECT DISTINCT conv_id FROM conversations)")
def first_wrong_step(spark, sf):
    right, step = H.first_wrong_step(F.col("conv_id") % 5 - 1)
    return load_table(spark, sf, "conversations").select("conv_id").distinct().select("conv_id", right.alias("is_correct"), step.alias("error_step"))


@query("q_document_ids", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'micro' WHEN 1 THEN 'meso' ELSE 'macro' END AS level, CASE WHEN doc_id % 3 = 0 THEN 'p' || doc_id || '__meso__s' || (doc_id % 4) || '_p' || (doc_id % 7) END AS parent FROM documents")
def document_ids(spark, sf):
    n = F.col("doc_id")
    name = F.concat(F.lit("p"), n.cast("string"), F.element_at(F.array(F.lit("__micro__s"), F.lit("__meso__s"), F.lit("__macro__s")), (n % 3 + 1).cast("int")), (n % 4).cast("string"), F.lit("_p"), (n % 7).cast("string"), F.when(n % 3 == 0, "_c2").otherwise(""))
    return load_table(spark, sf, "documents").select("doc_id", X.id_level(name).alias("level"), X.parent_id(name).alias("parent"))


@query("q_target_column", "SELECT (SELECT count(*) FROM labels WHERE toxic = 1) AS from_preferred, (SELECT count(*) FROM labels WHERE quality = 1) AS from_other")
def target_column(spark, sf):
    labels = load_table(spark, sf, "labels").withColumn("missing", F.lit(None).cast("int"))
    positives = lambda preferred: H.target_column(labels, preferred, "quality").agg(F.count_if(F.col("target") == 1).alias("n"))
    return positives("toxic").withColumnRenamed("n", "from_preferred").crossJoin(positives("missing").withColumnRenamed("n", "from_other"))


@query("q_feature_family", "SELECT event_id, CASE WHEN contains(event_type, 'c') THEN 'with_c' WHEN contains(event_type, 'i') THEN 'with_i' ELSE 'other' END AS family FROM events")
def feature_family(spark, sf):
    return load_table(spark, sf, "events").select("event_id", H.feature_family(F.col("event_type"), [("c", "with_c"), ("i", "with_i")]).alias("family"))


@query("q_yes_no", "WITH t AS (SELECT p_partkey, lower(trim(p_name || CASE p_partkey % 4 WHEN 0 THEN ' yes' WHEN 1 THEN ' NO' WHEN 2 THEN ' yes or no' ELSE '' END)) AS t FROM part) SELECT p_partkey, CASE WHEN contains(t, 'yes') AND NOT contains(t, 'no') THEN true WHEN contains(t, 'no') AND NOT contains(t, 'yes') THEN false WHEN starts_with(t, 'yes') THEN true WHEN starts_with(t, 'no') THEN false END AS answer FROM t")
def yes_no(spark, sf):
    ending = F.element_at(F.array(*(F.lit(x) for x in (" yes", " NO", " yes or no", ""))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return load_table(spark, sf, "part").select("p_partkey", X.yes_no(F.concat("p_name", ending)).alias("answer"))


@query("q_final_answer", "SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN trim(p_type) END AS answer, CASE WHEN p_partkey % 3 > 0 THEN chr((65 + p_partkey % 4)::INT) END AS letter FROM part")
def final_answer(spark, sf):
    letter = F.char(65 + F.col("p_partkey") % 4)
    text = F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("Final answer: none\nFINAL ANSWER:  "), "p_type", F.lit(" \nend"))).otherwise(F.lit("no mark"))
    choice = F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("Option ("), F.lower(letter), F.lit(") it is"))).otherwise("nothing")
    return load_table(spark, sf, "part").select("p_partkey", X.final_answer(text).alias("answer"), X.choice_letter(choice).alias("letter"))


@query("q_rubric", "SELECT p_partkey, 2::BIGINT AS items, 3.5::DOUBLE AS points, trim(p_name) || '|' || trim(p_type) AS described, round(least(p_size / 10, 1.5::DOUBLE) + 2, 6) AS total, round(CASE WHEN p_size > 25 THEN p_size / 50 END, 6) AS share FROM part")
def rubric(spark, sf):
    part = load_table(spark, sf, "part")
    text = F.concat(F.lit("Points: 1.5, Item: "), "p_name", F.lit("\nPoints: 2, Item: "), "p_type")
    rows = part.select("p_partkey", "p_size", X.rubric_items(text).alias("items"))
    maxima = F.transform("items", lambda i: i["points"])
    total = H.rubric_total(F.array(F.col("p_size") / 10, F.lit(7.0)), maxima)
    share = H.guarded_ratio(F.col("p_size").cast("double"), F.when(F.col("p_size") > 25, 50).otherwise(0))
    return rounded(rows.select("p_partkey", F.size("items").cast("bigint").alias("items"), F.aggregate(maxima, F.lit(0.0), lambda x, y: x + y).alias("points"), F.array_join(F.transform("items", lambda i: i["description"]), "|").alias("described"), total.alias("total"), share.alias("share")))


@query("q_thinking", "SELECT p_partkey, trim(p_name) AS inside, trim(p_type) AS outside FROM part")
def thinking(spark, sf):
    inside, outside = X.split_thinking(F.concat(F.lit("<think> "), "p_name", F.lit("\n</think>\n"), "p_type"))
    return load_table(spark, sf, "part").select("p_partkey", inside.alias("inside"), outside.alias("outside"))


@query("q_slugs", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || '-' || p_brand), '[^a-z0-9.]+', '-', 'g'), '^-|-$', '', 'g') AS slug, substr(md5(p_name), 1, 16) AS key FROM part")
def slugs(spark, sf):
    return load_table(spark, sf, "part").select("p_partkey", X.slug(F.col("p_name"), F.col("p_brand")).alias("slug"), X.pair_key(F.col("p_name")).alias("key"))


@query("q_truncated", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END::INT AS truncated FROM events")
def truncated(spark, sf):
    status = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("submitted ("), F.lit("EXIT_cost)"))).when(F.col("event_id") % 3 == 1, "submitted")
    return load_table(spark, sf, "events").select("event_id", X.truncated(status).alias("truncated"))


@query("q_choices", "SELECT p_partkey, 4 AS options, true AS found, 'Q: ' || p_name || ' A: ' || p_type AS free_form FROM part")
def choices(spark, sf):
    """Four options in hash order, the letter of the right one, and the same item without options."""
    wrong = F.array(F.lit("x"), F.lit("y"), F.lit("z"))
    options, letter = H.shuffled_choices(F.col("p_partkey"), F.col("p_type"), wrong)
    rows = load_table(spark, sf, "part").select("p_partkey", "p_name", "p_type", options.alias("o"), letter.alias("l"))
    right = F.get("o", F.ascii("l") - F.lit(65)) == F.col("p_type")
    return rows.select("p_partkey", F.size("o").alias("options"), right.alias("found"), F.concat(F.lit("Q: "), "p_name", F.lit(" A: "), "p_type").alias("free_form"))


@query("q_flat_series", "SELECT user_id, round(list_max(xs) - list_min(xs), 9) + 0.0 AS spread FROM (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN list_transform(range(count(*)), lambda i: 1 + i * 1e-6::DOUBLE) ELSE list(value) END AS xs FROM events GROUP BY user_id) WHERE user_id % 2 = 0 OR list_max(xs) <> list_min(xs)")
def flat_series(spark, sf):
    per = load_table(spark, sf, "events").groupBy("user_id").agg(F.collect_list("value").alias("v"))
    series = F.when(F.col("user_id") % 2 == 0, F.transform("v", lambda x: F.lit(1.0))).otherwise(F.col("v"))
    rows = per.select("user_id", H.ramped(series).alias("xs")).where((F.col("user_id") % 2 == 0) | (F.array_max("xs") != F.array_min("xs")))
    return rounded(rows.select("user_id", (F.array_max("xs") - F.array_min("xs")).alias("spread")), 9)


@query("q_text_mode", "SELECT doc_id, CASE WHEN lang <> 'en' THEN 'full_text' ELSE 'abstract' END AS mode, md5(CASE WHEN lang <> 'en' THEN 'T' || source ELSE source END) AS digest FROM documents")
def text_mode(spark, sf):
    full = F.when(F.col("lang") != "en", F.concat(F.lit("T"), "source")).otherwise(F.when(F.col("doc_id") % 2 == 0, "  "))
    text, mode = H.text_or_abstract(full, F.col("source"))
    return load_table(spark, sf, "documents").select("doc_id", mode.alias("mode"), F.md5(text).alias("digest"))


@query("q_record_shapes", "SELECT CASE conv_id % 5 WHEN 0 THEN 'trajectory' WHEN 1 THEN 'annotation' WHEN 2 THEN 'step' WHEN 3 THEN 'label' ELSE 'other' END AS shape, count(*) AS n FROM conversations GROUP BY 1")
def record_shapes(spark, sf):
    kinds = [F.struct(F.array("text").alias("messages")), F.struct(F.array("turn").alias("step_annotations")), F.struct(F.col("turn").alias("step"), F.col("role").alias("label")), F.struct(F.col("role").alias("label")), F.struct("text")]
    record = F.to_json(kinds[4])
    for i, kind in enumerate(kinds[:4]):
        record = F.when(F.col("conv_id") % 5 == i, F.to_json(kind)).otherwise(record)
    return load_table(spark, sf, "conversations").groupBy(H.record_shape(record).alias("shape")).agg(F.count("*").alias("n"))


@query("q_gold_answers", "WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS ts FROM conversations GROUP BY conv_id) SELECT conv_id, md5(ts[(conv_id % 7)::INT + 1]) AS digest FROM c WHERE conv_id % 7 < len(ts)")
def gold_answers(spark, sf):
    rows = load_table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("ts"))
    named = rows.withColumn("id", F.concat(F.lit("p"), F.col("conv_id").cast("string"), F.lit("__q"), (F.col("conv_id") % 7).cast("string")))
    return H.gold_answers(named, "id", "ts").select("conv_id", F.md5("gold").alias("digest"))


@query("q_tagged_union", "SELECT origin, count(*) AS n, count(lang) AS with_lang, sum(length(text))::BIGINT AS chars FROM (SELECT 'documents' AS origin, text, lang FROM documents UNION ALL SELECT 'benchmark', text, NULL FROM benchmark) GROUP BY origin")
def tagged_union(spark, sf):
    rows = H.tagged_union({"documents": load_table(spark, sf, "documents").select("text", "lang"), "benchmark": load_table(spark, sf, "benchmark").select("text")})
    return rows.groupBy("origin").agg(F.count("*").alias("n"), F.count("lang").alias("with_lang"), F.sum(F.char_length("text")).alias("chars"))


@query("q_collapse", "SELECT source, arg_min(lang, doc_id) AS lang, md5(arg_min(text, doc_id)) AS digest FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id = 0) GROUP BY source")
def collapse(spark, sf):
    rows = load_table(spark, sf, "documents")
    return H.collapse(rows, "source", ["lang", "text"], "doc_id", rows.where("doc_id = 0")).select("source", "lang", F.md5("text").alias("digest"))


@query("q_unique_guard", "SELECT count(*) AS n, sum(quality)::BIGINT AS positives FROM labels")
def unique_guard(spark, sf):
    return H.unique_rows(load_table(spark, sf, "labels"), ["doc_id"]).agg(F.count("*").alias("n"), F.sum("quality").cast("bigint").alias("positives"))


@query("q_sections", "WITH p AS (SELECT doc_id, source, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ps FROM documents) SELECT doc_id, -2 AS section_index, 1 AS paragraphs, md5(source) AS digest FROM p UNION ALL SELECT doc_id, -1, 1, md5(ps[1]) FROM p WHERE len(ps) > 0 UNION ALL SELECT doc_id, 0, len(ps)::INT, md5(array_to_string(ps, '|')) FROM p WHERE len(ps) > 0")
def sections(spark, sf):
    ps = F.split("text", "\n")
    first = F.get(F.filter(ps, lambda p: F.trim(p) != ""), F.lit(0))
    papers = load_table(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), F.col("source").alias("title"), F.coalesce(first, F.lit("")).alias("abstract"), F.array(F.struct(F.lit("body").alias("section_name"), ps.alias("paragraphs")), F.struct(F.lit("empty").alias("section_name"), F.array(F.lit(" ")).alias("paragraphs"))).alias("sections"))
    return L.sections_of(papers).select(F.col("paper_id").alias("doc_id"), "section_index", F.size("paragraphs").alias("paragraphs"), F.md5(F.array_join("paragraphs", "|")).alias("digest"))


@query("q_micro_index", f"{_SENT}, n AS (SELECT doc_id, parts, greatest(ceil((len(parts) - 3) / 2.0), 0)::INT AS last FROM sn WHERE len(parts) > 0), c AS (SELECT doc_id, parts, unnest(range(0, last + 1)) AS i FROM n), t AS (SELECT doc_id, array_to_string(parts[2 * i + 1:2 * i + 3], ' ') AS text FROM c), w AS (SELECT source, t.text, {W.replace('text', 't.text')} AS words FROM t JOIN documents USING (doc_id)) SELECT source, 'micro' AS level, count(*) AS docs, sum(words)::BIGINT AS words FROM w WHERE words >= 5 GROUP BY source")
def micro_index(spark, sf):
    """The index's third level: chunks of three sentences with at least five words."""
    chunks = docs(spark, sf).select("source", F.explode(X.sentence_chunks(X.sentences(F.col("text")))).alias("parts"))
    counted = chunks.select("source", X.word_count(F.array_join("parts", " ")).alias("words")).where("words >= 5")
    return counted.groupBy("source", F.lit("micro").alias("level")).agg(F.count("*").alias("docs"), F.sum("words").cast("bigint").alias("words"))


@query("q_finite_rows", "SELECT count(*) FILTER (WHERE event_id % 4 = 0) AS finite_rows, count(*) AS filled_rows, round(sum(value) FILTER (WHERE event_id % 4 = 0), 4) AS filled_sum FROM events")
def finite_rows(spark, sf):
    turn = F.col("event_id") % 4
    odd = load_table(spark, sf, "events").select(F.when(turn == 1, float("nan")).when(turn == 2, float("inf")).when(turn == 0, F.col("value")).alias("v"))
    return sources.finite(odd, ["v"]).agg(F.count("*").alias("finite_rows")).crossJoin(sources.finite(odd, ["v"], 0.0).agg(F.count("*").alias("filled_rows"), F.round(F.sum("v"), 4).alias("filled_sum")))


# Sources: tables that are written to shared storage and read back.
_EVENT_SUMS = "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type"
_EVENT = "event_id bigint, event_type string, value double"


def _sums(df):
    return df.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _events(spark, sf):
    return load_table(spark, sf, "events").select("event_id", "event_type", "value")


@query("q_jsonl_round_trip", _EVENT_SUMS)
def jsonl_round_trip(spark, sf):
    folder = files.scratch(spark, "jsonl")
    sources.write_jsonl(_events(spark, sf).where("event_type = 'view'"), folder)
    sources.write_jsonl(_events(spark, sf).where("event_type <> 'view'"), folder, append=True)
    return _sums(sources.read_jsonl(spark, folder, _EVENT))


@query("q_json_document_round_trip", _EVENT_SUMS)
def json_document_round_trip(spark, sf):
    folder = files.scratch(spark, "json")
    sources.write_json_document(_events(spark, sf), folder)
    return _sums(sources.read_json_document(spark, folder, _EVENT))


@query("q_csv_round_trip", "SELECT event_type, count(*) AS n, round(sum(value) FILTER (WHERE event_id % 2 = 0), 4) AS total FROM events GROUP BY event_type")
def csv_round_trip(spark, sf):
    folder = files.scratch(spark, "csv")
    sources.write_features(_events(spark, sf).withColumn("value", F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(float("nan"))), folder)
    return _sums(sources.read_features(spark, folder, _EVENT))


@query("q_parquet_round_trip", _EVENT_SUMS)
def parquet_round_trip(spark, sf):
    folder = files.scratch(spark, "tables")
    sources.write_table(_events(spark, sf), folder, "events")
    return _sums(load_table(spark, folder, "events"))


@query("q_many_files", "SELECT 'good' AS kind, count(*) AS n FROM events UNION ALL SELECT 'unreadable', 2")
def many_files(spark, sf):
    from pyspark.sql.types import StructType

    folder = files.scratch(spark, "many")
    sources.write_jsonl(_events(spark, sf), f"{folder}/a")
    spark.range(2).select(F.lit("{broken").alias("value")).write.text(f"{folder}/b/c")
    good, bad = sources.read_many(spark, [folder], StructType.fromDDL(_EVENT))
    return good.agg(F.lit("good").alias("kind"), F.count("*").alias("n")).unionByName(bad.agg(F.lit("unreadable").alias("kind"), F.count("*").alias("n")))


@query("q_relabel_batches", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id")
def relabel_batches(spark, sf):
    rows = load_table(spark, sf, "events").select("user_id", "event_type", "event_id")
    return sources.latest_labels(rows, "user_id", "event_type", "event_id", ["view", "click"]).select("user_id", "event_type")


@query("q_stage_output", f"SELECT count(*) AS n, sum(words)::BIGINT AS words FROM ({DOCS})")
def stage_output(spark, sf):
    """A stage that is made once; the second call finds its output."""
    from ..sources.runs import stage_output as once

    path = files.scratch(spark, "stage")
    once(spark, path, lambda: docs(spark, sf).select("doc_id", "words"))
    return once(spark, path, lambda: spark.range(0).select("id")).agg(F.count("*").alias("n"), F.sum("words").alias("words"))
