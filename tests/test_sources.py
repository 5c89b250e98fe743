from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from tracewell import sources
from tracewell.sources import runs


def test_json_lines_and_documents(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    path = f"file://{tmp_path}/x"
    sources.write_jsonl(df, path)
    sources.write_jsonl(df, path, append=True)
    assert sorted(r.id for r in sources.read_jsonl(spark, path, "id int, t string").collect()) == [1, 1, 2, 2]
    sources.write_json_document(df, f"file://{tmp_path}/d")
    assert sources.read_json_document(spark, f"file://{tmp_path}/d", "id int, t string").count() == 2


def test_features_turn_nan_into_null(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 0.5), (3, None)], "id int, x double")
    sources.write_features(df, f"file://{tmp_path}/f")
    assert {r.id: r.x for r in sources.read_features(spark, f"file://{tmp_path}/f", "id int, x double").collect()} == {1: None, 2: 0.5, 3: None}


def test_many_files_with_unreadable_ones(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/good.json").write_text('{"id": 1}\n{"id": 2}\n')
    (tmp_path / "a/bad.json").write_text("{nothing\n")
    good, bad = sources.read_many(spark, [f"file://{tmp_path}"], StructType().add("id", IntegerType()))
    assert sorted(r.id for r in good.cache().collect()) == [1, 2] and good.where(F.col("file").endswith("good.json")).count() == 2
    assert bad.cache().count() == 1


def test_files_that_are_one_value(spark, tmp_path):
    (tmp_path / "one.json").write_text('{\n  "id": 1\n}\n')
    (tmp_path / "many.json").write_text('[{"id": 2},\n {"id": 3}]')
    (tmp_path / "bad.json").write_text("{\nnothing")
    good, bad = sources.read_many(spark, [f"file://{tmp_path}"], StructType().add("id", IntegerType()), whole=True)
    assert sorted(r.id for r in good.cache().collect()) == [1, 2, 3]
    assert [r.file.rsplit("/", 1)[1] for r in bad.cache().collect()] == ["bad.json"]


def test_json_documents_of_any_size(spark, tmp_path):
    for n in (0, 1, 1000):
        sources.write_json_document(spark.range(n).repartition(4), f"file://{tmp_path}/{n}")
        assert sorted(r.id for r in sources.read_json_document(spark, f"file://{tmp_path}/{n}", "id bigint").collect()) == list(range(n))


def test_latest_labels(spark):
    df = spark.createDataFrame([("s", "macro", 1), ("s", "micro", 2), ("s", "??", 3), ("t", "meso", 1)], "span string, label string, batch int")
    assert {r.span: r.label for r in sources.latest_labels(df, "span", "label", "batch", ["macro", "meso", "micro"]).collect()} == {"s": "micro", "t": "meso"}


def test_runs(spark, tmp_path):
    for name in ("model-a_1", "model-a_2", "model-b"):
        (tmp_path / name).mkdir()
    assert runs.resolve_run(str(tmp_path), "model-b").endswith("model-b") and runs.resolve_run(str(tmp_path), "model-a_1").endswith("_1")
    for bad in ("model-a", "none"):
        with pytest.raises(FileNotFoundError):
            runs.resolve_run(str(tmp_path), bad)
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert runs.stage_output(spark, f"file://{tmp_path}/out", make).count() == 3
    assert made == [1]
    registry = runs.DatasetRegistry()
    registry.register("x", produce=lambda n: spark.range(n))
    assert registry.produce("x", 4).count() == 4
    with pytest.raises(KeyError):
        registry.produce("y")
    with pytest.raises(NotImplementedError):
        registry.slice_label("x")
