"""The registered queries op1 to op13 and pipeline, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import embeddings, lexical, media, minhash, packing, periodic, pitmanyor, quality, rules, suffixdedup, warc, wavelet, wordtable


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_table(spark, sf_dir, "documents"), _path("word_bpe_49k.json"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=2).select("doc_id", "n_shingles", "component_id", "kept")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(_table(spark, sf_dir, "documents"))


def op6_bpe_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordtable.encode_decode(_table(spark, sf_dir, "documents"), _path("word_bpe_49k.json"))


def op7_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_shards(_table(spark, sf_dir, "documents"), _path("byte_bpe_50k.json"))


def op8_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitmanyor.text_scores(_table(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.removal_digests(_table(spark, sf_dir, "documents"))


def op11_impact_ordered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_minhash_near_dedup": op2_minhash_near_dedup,
        "op3_warc": op3_warc,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_media_columns": op5_media_columns,
        "op6_bpe_word_table": op6_bpe_word_table,
        "op7_wavelet_tokens": op7_wavelet_tokens,
        "op8_pitman_yor_scores": op8_pitman_yor_scores,
        "op9_embedding_near_dedup": op9_embedding_near_dedup,
        "op10_suffix_array_dedup": op10_suffix_array_dedup,
        "op11_impact_ordered_search": op11_impact_ordered_search,
        "op12_quality_rules": op12_quality_rules,
        "op13_periodic_runs": op13_periodic_runs,
        "pipeline": corpus_pipeline.run,
    }


#: Pages with equal payloads: the first is the response.  Base 32 by groups of 20 bits of the hexadecimal digest.
OP3_SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, upper(sha1(h)) AS x FROM p),
b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(8), lambda i: list_transform([('0x' || substr(x, (5 * i + 1)::INT, 5))::INT], lambda n: {" || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (n >> {k}) % 32 + 1, 1)" for k in (15, 10, 5, 0))})[1]), '') AS payload_digest FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS m FROM b)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN m = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN m <> page_id THEN m END AS refers_to FROM f"""

#: Pairs by the rarest shingles of each document (of two similar documents they share one), confirmed on whole sets.
OP2_SQL = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) > 1 THEN list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i::INT] || ' ' || ws[(i + 1)::INT])) ELSE ws END AS ss FROM w),
n AS (SELECT doc_id, len(ss)::BIGINT AS n FROM s), e AS (SELECT doc_id, hash(unnest(ss)) AS g FROM s), c AS (SELECT doc_id, n, g, row_number() OVER (PARTITION BY doc_id ORDER BY df, g) AS place FROM e JOIN n USING (doc_id) JOIN (SELECT g, count(*) AS df FROM e GROUP BY g HAVING count(*) > 1) USING (g)),
pre AS (SELECT c.doc_id, c.n, c.g FROM c WHERE place <= n - ceil(0.8 * n) + 1),
pairs AS (SELECT DISTINCT a.doc_id AS u, b.doc_id AS v FROM pre a JOIN pre b ON a.g = b.g AND a.doc_id < b.doc_id AND a.n * 100 >= 80 * b.n AND b.n * 100 >= 80 * a.n),
links AS (SELECT u, v FROM pairs JOIN s a ON a.doc_id = u JOIN s b ON b.doc_id = v WHERE 100 * len(list_intersect(a.ss, b.ss)) >= 80 * (len(a.ss) + len(b.ss) - len(list_intersect(a.ss, b.ss)))),
bo AS (SELECT u, v FROM links UNION SELECT v, u FROM links), reach AS (SELECT u, v FROM bo UNION SELECT r.u, b.v FROM reach r JOIN bo b ON b.u = r.v), m AS (SELECT u, min(v) AS m FROM reach GROUP BY u)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept FROM n LEFT JOIN m ON u = doc_id"""

OP9_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0))),
links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT u, w FROM links UNION SELECT r.u, l.w FROM reach r JOIN links l ON l.u = r.w),
n AS (SELECT u, count(*) AS n FROM links GROUP BY u), c AS (SELECT u, min(w) AS m FROM reach GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept FROM v LEFT JOIN n ON n.u = vec_id LEFT JOIN c ON c.u = vec_id"""

#: All documents that share a term with an item, with the score's integer arithmetic.
OP11_SQL = """WITH tokens AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS r FROM asked GROUP BY ALL), tf AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY ALL), n AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY ALL),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM n), m AS (SELECT doc_id, 100 - 25 + ((25 * n * docs) // total) AS m FROM n, s),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, docs),
scores AS (SELECT item_id, doc_id, sum(r * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20"""

#: Repeated windows by a row per window; the rules are those of the table, written as one condition.
OP12_SQL = f"""WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents), a AS (SELECT k, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
starts AS (SELECT k, ws, unnest(range(1, len(ws) - 6)) AS i FROM a WHERE len(ws) > 8), windows AS (SELECT k, i, count(*) OVER (PARTITION BY k, array_to_string(ws[i:i + 7], ' ')) AS times FROM starts),
covered AS (SELECT k, least(8, coalesce(lead(i) OVER (PARTITION BY k ORDER BY i) - i, 8)) AS n FROM windows WHERE times > 1), r AS (SELECT k, sum(n)::BIGINT AS n FROM covered GROUP BY k),
c AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(regexp_extract_all(t, '[!?]')) AS n_exclamations, len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_capitals,
len(list_filter(ws, lambda w: list_contains({rules.STOP_WORDS!r}, lower(w)))) AS n_stop_words, len(ls) AS n_lines, len(list_filter(ls, lambda x: regexp_matches(x, '{rules.BULLET_LINE}'))) AS n_bullet_lines, len(list_filter(ls, lambda x: regexp_matches(x, '{rules.ELLIPSIS_LINE}'))) AS n_ellipsis_lines FROM a LEFT JOIN r USING (k)),
v AS (SELECT *, n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > {rules.MOST_REPEATED} * n_words AS base_failed, {rules.compiled_sql()} AS rule_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rule_failed AS kept FROM v"""


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can express; the others are tested against brute force, round trips and held-out rows."""
    return {"op2_minhash_near_dedup": OP2_SQL, "op3_warc": OP3_SQL, "op9_embedding_near_dedup": OP9_SQL, "op11_impact_ordered_search": OP11_SQL, "op12_quality_rules": OP12_SQL}
