"""Corpus preparation in four stages, from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet in shared storage and reads again as the next stage's docs.
All but the last return the columns of documents, whatever further columns
there are and however they are named.

Defined results: a null text counts as an empty one; an empty table gives empty
tables; rows that share an id are one document in the near-dedup and stay
together; rows without an id are scored and packed like others, and of those
whose texts are equal or near each other one stays; ties of equal documents go
to the smallest id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import minhash, packing, quality, suffixdedup, work

#: Scores below are rejected, as in the quality query.
LEAST_QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels of the stage's own documents, accepts."""
    work.workspace(spark, "quality")
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = work.unused(docs, "quality_score")
    return quality.scored(docs, model, score_col=score).where(F.col(score) >= LEAST_QUALITY).drop(score)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the one of the smallest id.

    Rows that share an id are one document and stay together.  A group without any id keeps one row of the text
    with the smallest hash.
    """
    folder = work.workspace(spark, "near_dedup")
    found = work.materialize(minhash.near_duplicates(docs).where("kept"), f"{folder}/kept")
    kept = work.unused(docs, "kept_id")
    # Always by a shuffle of both sides: a broadcast of few ids would make small and large inputs behave differently.
    ids = found.where("doc_id is not null").select(F.col("doc_id").alias(kept)).distinct()
    named = docs.join(ids.hint("merge"), F.col("doc_id") == F.col(kept), "left_semi")
    body = F.xxhash64(F.col("text").cast("binary"))
    leads = found.where("doc_id is null and (lead_body is null or body = lead_body)").select(F.col("body").alias(kept)).distinct()
    nameless = docs.where("doc_id is null").join(leads, body == F.col(kept), "left_semi")
    # Texts without words are no duplicates of each other.
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return named.unionByName(nameless.where(blank)).unionByName(nameless.where(~blank).dropDuplicates(["text"]))


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the 100-byte strings that start earlier; n_chars follows the text."""
    return suffixdedup.without_repeats(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequence and place in it."""
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("suffix_dedup", suffix_dedup_stage), ("packing", packing_stage)]

#: The classifier, signatures, tokens and packing aren't expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table."""
    folder = work.workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.materialize(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs
