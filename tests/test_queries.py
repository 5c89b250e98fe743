"""Every registered query runs, and equals its SQL where it has one."""

from __future__ import annotations

import pytest
from compare import difference, duck
from pyspark.sql import functions as F

from tracewell import plans

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_equals_sql(spark, con, name):
    assert difference(name, plans.queries()[name], plans.oracle_sql()[name], spark, con, DATA) is None


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs(spark, name):
    assert plans.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert len(__spark_entry__.entry(spark).collect()) > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_every_part_is_compared(spark):
    part = spark.read.parquet(f"{DATA}/part.parquet").collect()
    ratios = plans.queries()["q_similarity_ratio"](spark, DATA).collect()
    assert sorted(r.p_partkey for r in ratios) == sorted(r.p_partkey for r in part)
    near = lambda x, y: abs(x - y) <= 0.02 * abs(y)
    found = {r.x: r for r in plans.queries()["q_best_fuzzy_match"](spark, DATA).collect()}
    assert len(found) == len(part)
    for a in part:
        scores = []
        for b in part:
            if a.p_brand == b.p_brand:
                x, y, s, t = a.p_retailprice, b.p_retailprice / 100, a.p_type.lower(), b.p_type.lower()
                scores.append((1 + (s in t or t in s) + any(near(z, y) for z in (x, x * 100, x * 0.01)), -b.p_partkey))
        score, key = max(scores)
        assert (found[a.p_partkey].score, found[a.p_partkey].matched) == (score, -key)


def test_mean_sentence_lengths_end_in_half_a_unit(spark, tmp_path):
    """Means over 640, 1,280 and 1,920 sentences have seven digits; two texts have no sentence."""
    texts = ["a. " * (n - 1) + "a " * (k + 1) for n in (128, 640, 1_280, 1_920) for k in range(0, 120, 3)] + ["... !?", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'s' source", "'l' lang", "length(text) n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    name = "q_sentence_length"
    assert difference(name, plans.queries()[name], plans.oracle_sql()[name], spark, duck(str(tmp_path)), str(tmp_path)) is None


def test_pairs_of_one_group_are_made_by_several_tasks(spark, tmp_path):
    """3,000 parts of one size and brand, in one file: 4.5 million pairs, each once."""
    rows = spark.range(3_000).selectExpr("id p_partkey", "'b' p_brand", "1 p_size", "id / 7 p_retailprice")
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    out = plans.queries()["q_fuzzy_numeric_match"](spark, str(tmp_path))
    found = out.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.count_if("matched").alias("matched"), F.sum(F.col("a") * 3_000 + F.col("b")).alias("keys")).collect()
    assert len(found) > 1 and max(r.n for r in found) < 4_498_500
    sql = f"SELECT count(*), count(*) FILTER (WHERE matched), sum(a * 3000 + b) FROM ({plans.oracle_sql()['q_fuzzy_numeric_match']})"
    assert tuple(sum(r[k] for r in found) for k in ("n", "matched", "keys")) == duck(str(tmp_path)).execute(sql).fetchone()
