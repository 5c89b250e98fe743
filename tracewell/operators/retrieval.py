"""Scoring, ranking and evaluation of passages inside a document group.

All joins keep the group key, so candidates are never a product of the whole
tables.  Text overlap is an equi-join on tokens with counts; pairs without a
common token have no row and count as zero.  Ties of a score are broken by the
document id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from . import tiles

BM25_K1, BM25_B, IDF_FLOOR = 1.5, 0.75, 0.25
BOOST, LEAST_CONFIDENCE, DENSE_WEIGHT = 0.5, 0.6, 0.7


def token_counts(df: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """Rows (keys, token, n, size): how often each token occurs, and how many tokens there are.

    Texts are shuffled once, by their keys, and what is counted of a text stays in its partition.
    """
    rows = df.repartition(*keys).select(*keys, F.explode(tokens).alias("token"))
    counts = rows.groupBy(*keys, "token").agg(F.count("*").alias("n"))
    return counts.withColumn("size", F.sum("n").over(Window.partitionBy(*keys)))


def overlap_f1(left: DataFrame, right: DataFrame, group: str, left_id: str, right_id: str) -> DataFrame:
    """Token-F1 of pairs of a group with a common token, from two tables of token counts; the right one is sent to every task."""
    counts = right.select(group, right_id, "token", F.col("n").alias("__b"), F.col("size").alias("__right"))
    pairs = left.select(group, left_id, "token", F.col("n").alias("__a"), F.col("size").alias("__left")).join(F.broadcast(counts), [group, "token"])
    sums = pairs.groupBy(group, left_id, right_id).agg(F.sum(F.least("__a", "__b")).alias("overlap"), F.first("__left").alias("__left"), F.first("__right").alias("__right"))
    return sums.select(group, left_id, right_id, "overlap", (2 * F.col("overlap") / (F.col("__left") + F.col("__right"))).alias("f1"))


def likely_pairs(left: DataFrame, right: DataFrame, group: str, left_id: str, right_id: str, least: float) -> DataFrame:
    """Pairs of a group that may have a token-F1 of ``least``; all that have are among them.

    Of two such texts each holds a share least / (2 - least) of the other's tokens, so they have a token in common
    among their rarest ones, beyond which only fewer tokens are left; texts of too different lengths are no pair.
    Rare is what few texts on the right have, which is the side that is sent to every task.
    """
    if not 0 < least <= 1:
        raise ValueError("the least F1 is above 0 and at most 1")
    share = least / (2 - least)
    common = right.groupBy(group, "token").agg(F.count("*").alias("__df"))

    def rarest(side: DataFrame, key: str) -> DataFrame:
        rows = side.join(F.broadcast(common), [group, "token"], "left").withColumn("__df", F.coalesce("__df", F.lit(0)))
        before = F.sum("n").over(Window.partitionBy(group, key).orderBy("__df", "token").rowsBetween(Window.unboundedPreceding, -1))
        needed = F.ceil(F.col("size") * share - 1e-9)
        return rows.withColumn("__before", F.coalesce(before, F.lit(0))).where(F.col("__before") <= F.col("size") - needed).select(group, key, "token", "size")

    a, b = rarest(left, left_id), rarest(right, right_id).withColumnRenamed("size", "__size")
    near = (F.col("__size") >= F.col("size") * share - 1e-9) & (F.col("size") >= F.col("__size") * share - 1e-9)
    return a.join(F.broadcast(b), [group, "token"]).where(near).select(group, left_id, right_id).distinct()


def overlap_f1_at_least(left: DataFrame, right: DataFrame, group: str, left_id: str, right_id: str, least: float) -> DataFrame:
    """The pairs of :func:`overlap_f1` with an F1 of ``least``, without a row for every common token of all pairs."""
    pairs = likely_pairs(left, right, group, left_id, right_id, least)
    one = pairs.join(left.select(group, left_id, "token", F.col("n").alias("__a"), F.col("size").alias("__left")), [group, left_id])
    both = one.join(F.broadcast(right.select(group, right_id, "token", F.col("n").alias("__b"), F.col("size").alias("__right"))), [group, right_id, "token"])
    sums = both.groupBy(group, left_id, right_id).agg(F.sum(F.least("__a", "__b")).alias("overlap"), F.first("__left").alias("__left"), F.first("__right").alias("__right"))
    f1 = 2 * F.col("overlap") / (F.col("__left") + F.col("__right"))
    return sums.select(group, left_id, right_id, "overlap", f1.alias("f1")).where(F.col("f1") >= least)


def token_f1(a: Column, b: Column, both_empty: float) -> Column:
    """Token-F1 of two token arrays with repeats; one empty side gives 0, two give ``both_empty``."""
    distinct = F.array_distinct(a)
    times = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    common = F.aggregate(F.transform(distinct, lambda t: F.least(times(a, t), times(b, t))), F.lit(0), lambda x, y: x + y)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), both_empty).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * common / (F.size(a) + F.size(b)))


def token_f1_plain(a: Column, b: Column) -> Column:
    """White-space tokens of normalized texts; an empty side gives 0."""
    return token_f1(X.tokens(a), X.tokens(b), 0.0)


def token_f1_no_punctuation(a: Column, b: Column) -> Column:
    """Tokens without punctuation; two empty texts give 1."""
    split = lambda c: F.filter(F.split(X.normalize_plain(c), " "), lambda w: w != "")
    return token_f1(split(a), split(b), 1.0)


def token_f1_content(a: Column, b: Column) -> Column:
    """Word-character tokens without stop words; two texts without any give 1."""
    return token_f1(X.content_tokens(a), X.content_tokens(b), 1.0)


def set_f1(a: Column, b: Column) -> Column:
    """F1 of the sets of two token arrays; 0 if one is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def bm25(documents: DataFrame, queries: DataFrame, group: str, doc_id: str = "doc_id", query_id: str = "query_id", text: str = "text") -> DataFrame:
    """Okapi BM25 of every query against the documents of its group that share a token with it.

    Statistics are per group.  A negative idf becomes IDF_FLOOR times the group's mean idf.  The terms of the queries
    are sent to every task, and a document's scores are added up where its terms are.
    """
    split = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    documents = documents.where(F.col(group).isNotNull())
    terms = token_counts(documents, [group, doc_id], split)
    sizes = documents.select(group, F.size(split).alias("__size")).groupBy(group).agg(F.count("*").alias("__docs"), F.avg("__size").alias("__avgdl"))
    found = terms.groupBy(group, "token").agg(F.count("*").alias("__df")).join(sizes, group)
    raw = F.log(F.col("__docs") - F.col("__df") + 0.5) - F.log(F.col("__df") + 0.5)
    found = found.withColumn("__raw", raw)
    means = found.groupBy(group).agg(F.avg("__raw").alias("__mean"))
    idf = found.join(means, group).select(group, "token", F.when(F.col("__raw") < 0, IDF_FLOOR * F.col("__mean")).otherwise(F.col("__raw")).alias("__idf"), "__avgdl")
    asked = queries.select(group, query_id, F.explode(split).alias("token")).groupBy(group, query_id, "token").agg(F.count("*").alias("__times"))
    weight = F.col("n") * (BM25_K1 + 1) / (F.col("n") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("size") / F.col("__avgdl")))
    return terms.join(F.broadcast(asked.join(idf, [group, "token"])), [group, "token"]).groupBy(group, query_id, doc_id).agg(F.sum(F.col("__times") * F.col("__idf") * weight).alias("bm25"))


def against_all(queries: DataFrame, rows: DataFrame, row_id: str) -> DataFrame:
    """Every query beside every row: a stated query set, in blocks.

    The rows are dealt into as many blocks as a shuffle has partitions, and the queries are sent to each.
    """
    blocks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("__block", F.pmod(F.xxhash64(row_id), F.lit(blocks)).cast("int"))
    return queries.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(dealt, "__block").drop("__block")


def min_max(score: str, *group: str) -> Column:
    """Score scaled to 0..1 inside a candidate group; 0 where all are equal."""
    w = Window.partitionBy(*group)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(0.0)


def cosine_candidates(queries: DataFrame, documents: DataFrame, group: str, digits: int = 9) -> DataFrame:
    """Cosine of every query and document of a group, rounded so that ties are ties in any engine.

    Expects columns group, query_id, qv and group, doc_id, dv.
    """
    return queries.join(documents, group).withColumn("cosine", F.round(V.cosine(F.col("qv"), F.col("dv")), digits)).drop("qv", "dv")


def effective_level(predicted: Column) -> Column:
    """The macro level is answered from paragraphs."""
    return F.when(predicted == "macro", "meso").otherwise(predicted)


def routed(candidates: DataFrame) -> DataFrame:
    """Only candidates of the predicted level; meso without a prediction."""
    return candidates.where(F.col("level") == F.coalesce("predicted", F.lit("meso")))


def routed_with_fallback(candidates: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """Candidates of the predicted level (macro as meso); all levels below a confidence, which is 1 where missing."""
    return candidates.where((F.coalesce("confidence", F.lit(1.0)) < least) | (F.col("level") == effective_level(F.col("predicted"))))


def searched_level(least: float = LEAST_CONFIDENCE) -> Column:
    """The one level whose candidates :func:`routed_with_fallback` leaves a query; NULL if it may leave all."""
    return F.when(F.coalesce("confidence", F.lit(1.0)) >= least, effective_level(F.col("predicted")))


def boosted(score: Column, weight: float = BOOST) -> Column:
    """Score times 1 + weight * confidence where the level is the predicted one; a negative score gets worse."""
    return F.when(F.col("level") == effective_level(F.col("predicted")), score * (1 + weight * F.coalesce("confidence", F.lit(0.5)))).otherwise(score)


def hybrid(candidates: DataFrame, *group: str, weight: float = DENSE_WEIGHT) -> Column:
    """Weighted sum of the scaled cosine and the scaled BM25."""
    return weight * min_max("cosine", *group) + (1 - weight) * min_max("bm25", *group)


def top_k(candidates: DataFrame, score: str, k: int, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """The k best candidates of each query with their rank from 1."""
    w = Window.partitionBy(query_id).orderBy(F.col(score).desc(), doc_id)
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def k_sweep(ranked: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10, 20)) -> DataFrame:
    """For every k the rows of rank up to k, from one ranking."""
    return ranked.select(F.explode(F.filter(F.array(*(F.lit(k) for k in ks)), lambda k: F.col("rank") <= k)).alias("k"), "*")


def with_parents(ranked: DataFrame, documents: DataFrame, query_id: str = "query_id", doc_id: str = "doc_id", parent: str = "parent_id") -> DataFrame:
    """Ranked rows and, behind them with score 0, the parents of ranked documents that aren't ranked themselves.

    Only parents that exist in ``documents`` (doc_id) are added; they follow in the order of their first child.
    """
    wanted = ranked.where(F.col(parent).isNotNull()).groupBy(query_id, F.col(parent).alias(doc_id)).agg(F.min("rank").alias("__child"))
    fresh = wanted.join(ranked.select(query_id, doc_id), [query_id, doc_id], "left_anti").join(documents.select(doc_id), doc_id, "left_semi")
    last = ranked.groupBy(query_id).agg(F.max("rank").alias("__last"))
    placed = fresh.join(last, query_id).withColumn("rank", F.col("__last") + F.row_number().over(Window.partitionBy(query_id).orderBy("__child", doc_id)))
    return ranked.select(query_id, doc_id, "rank", F.lit(False).alias("is_parent")).unionByName(placed.select(query_id, doc_id, "rank", F.lit(True).alias("is_parent")))


def reranked(candidates: DataFrame, score: str, pool: int, k: int, rerank: Column) -> DataFrame:
    """The best k of a pool by a second score, which the caller supplies as a column."""
    return top_k(top_k(candidates, score, pool).drop("rank").withColumn("rerank", rerank), "rerank", k)


def attribution(retrieved: DataFrame, gold: DataFrame, pairs: DataFrame, threshold: float, key: str = "query_id") -> DataFrame:
    """Precision, recall and F1 of retrieved passages that match gold ones, and the reciprocal rank of the first match.

    retrieved: key, doc_id, rank; gold: key, gold_id; pairs: key, doc_id, gold_id, f1.
    """
    hits = pairs.where(F.col("f1") >= threshold)
    n = retrieved.groupBy(key).agg(F.count("*").alias("retrieved"))
    g = gold.groupBy(key).agg(F.count("*").alias("gold"))
    matched = hits.join(retrieved, [key, "doc_id"]).groupBy(key).agg(F.count_distinct("doc_id").alias("hit"), F.count_distinct("gold_id").alias("found"), F.min("rank").alias("first"))
    joined = g.join(n, key, "left").join(matched, key, "left").na.fill(0, ["retrieved", "hit", "found"])
    p = F.when(F.col("retrieved") > 0, F.col("hit") / F.col("retrieved")).otherwise(0.0)
    r = F.col("found") / F.col("gold")
    scored = joined.select(key, p.alias("precision"), r.alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))
    both = F.col("precision") + F.col("recall")
    return scored.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def soft_attribution(retrieved: DataFrame, gold: DataFrame, pairs: DataFrame, key: str = "query_id") -> DataFrame:
    """Mean best overlap of retrieved passages (precision) and of gold ones (recall), and their harmonic mean."""
    inside = pairs.join(retrieved.select(key, "doc_id"), [key, "doc_id"], "left_semi")
    best_of = lambda items, item: items.join(inside.groupBy(key, item).agg(F.max("f1").alias("f1")), [key, item], "left").groupBy(key).agg(F.avg(F.coalesce("f1", F.lit(0.0))))
    p = best_of(retrieved.select(key, "doc_id"), "doc_id").toDF(key, "soft_precision")
    r = best_of(gold.select(key, "gold_id"), "gold_id").toDF(key, "soft_recall")
    both = F.col("soft_precision") + F.col("soft_recall")
    return r.join(p, key, "left").na.fill(0.0).withColumn("soft_f1", F.when(both > 0, 2 * F.col("soft_precision") * F.col("soft_recall") / both).otherwise(0.0))


def threshold_sweep(retrieved: DataFrame, gold: DataFrame, pairs: DataFrame, thresholds: tuple[float, ...] = (0.3, 0.4, 0.5, 0.6), key: str = "query_id") -> DataFrame:
    """Mean attribution F1 at each threshold."""
    out = None
    for t in thresholds:
        rows = attribution(retrieved, gold, pairs, t, key).agg(F.lit(t).alias("threshold"), F.avg("f1").alias("mean_f1"), F.avg("recall").alias("mean_recall"))
        out = rows if out is None else out.unionByName(rows)
    return out


def neighbour_purity(vectors: DataFrame, label: str, k: int = 15, id_col: str = "vec_id", vector: str = "embedding", block: int = 32_768) -> DataFrame:
    """Share of each vector's k nearest others, by Euclidean distance (rounded), that have its label.

    Exact, and quadratic by definition: every vector is a query against all rows.  A task takes one block of queries
    and one of rows; products of a tile tell which rows may be among the k nearest, only their distances are
    computed, and only the k nearest of each task leave it.
    Vectors that are null, or hold null or non-finite components, are nobody's neighbours and have the purity
    NULL; vectors of another length are no neighbours.
    """
    whole = F.col(vector).isNotNull() & F.forall(F.col(vector).cast("array<double>"), lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    every, vectors = vectors.select(id_col), vectors.where(whole)
    parallel = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = tiles.blocks_of(vectors.count(), block, tiles.FEWEST, math.ceil(math.sqrt(parallel)))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v")).where("id is not null")
    schema = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("same", pa.bool_()), ("distance", pa.float64())])

    def nearest(table: pa.Table) -> pa.Table:
        found = [schema.empty_table()]
        sides = [(t.column("id").to_numpy(), np.array(t.column("label").to_pylist(), object), *tiles.vectors(t.column("v"))) for t in tiles.sides(table)]
        for size in set(sides[0][3].tolist()):  # vectors of one length
            (ai, al, a, _), (bi, bl, b, _) = (tuple(x[side[3] == size] for x in side) for side in sides)
            for first, r, c, distance in tiles.nearest_of_rows(a[:, :size], ai, b[:, :size], bi, k):
                found.append(pa.table({"id": ai[first + r], "other": bi[c], "same": pa.array((bl[c] == al[first + r]).astype(bool)), "distance": distance}, schema))
        return pa.concat_tables(found)

    near = tiles.grid(rows, rows, blocks, blocks).applyInArrow(nearest, "id bigint, other bigint, same boolean, distance double")
    w = Window.partitionBy("id").orderBy("distance", "other")
    found = near.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).groupBy(F.col("id").alias(id_col)).agg(F.avg(F.col("same").cast("double")).alias("purity"))
    return every.join(found, id_col, "left")
