"""Nested records to rows: messages, episodes, evidence, questions, fuzzy matches and key alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def isin_or_all(column: Column, values: list | None) -> Column:
    """Membership; no list means no restriction."""
    return F.lit(True) if values is None else column.isin(values)


def role_chunks(messages: Column, role: str, most: int | None = None) -> Column:
    """Contents of the messages of a role, in order, at most ``most``."""
    own = F.transform(F.filter(messages, lambda m: m["role"] == role), lambda m: m["content"])
    return own if most is None else F.slice(own, 1, most)


def episodes(steps: DataFrame, keys: list[str], step: str, content: str) -> DataFrame:
    """Step rows as one row per episode: contents in order, first and last content, number of steps."""
    return steps.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(step, content))), lambda s: s[content]).alias("chunks"), F.min_by(content, step).alias("first"), F.max_by(content, step).alias("last"), F.count("*").alias("n_steps"))


def questions(df: DataFrame, evidence: str) -> DataFrame:
    """Union of the annotators' evidence in sorted order; rows without any go.  evidence: array<array<string>>."""
    flat = F.array_sort(F.array_distinct(F.filter(F.flatten(evidence), lambda e: F.trim(e) != "")))
    return df.withColumn("gold_evidence", flat).where(F.size("gold_evidence") > 0)


def annotator_majority(votes: Column) -> Column:
    """Majority of an array of booleans; a tie gives the first vote."""
    yes, no = F.size(F.filter(votes, lambda v: v)), F.size(F.filter(votes, lambda v: ~v))
    return F.when(yes > no, True).when(no > yes, False).otherwise(F.get(votes, F.lit(0)))


def first_wrong_step(label: Column) -> tuple[Column, Column]:
    """(is_correct, error_step_index) of a label where -1 says that all steps are right."""
    return label == -1, F.when(label != -1, label)


def target_column(df: DataFrame, preferred: str, other: str) -> DataFrame:
    """Column target of the whole table: the preferred column if it has any value, else the other."""
    some = df.agg((F.count(preferred) > 0).alias("__some"))
    return df.crossJoin(F.broadcast(some)).withColumn("target", F.when(F.col("__some"), F.col(preferred)).otherwise(F.col(other))).drop("__some")


def merge_last(left: DataFrame, right: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Inner join with the last build row per key, and the left rows that miss."""
    last = Window.partitionBy(key).orderBy(F.col(order).desc())
    unique = right.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", order)
    return left.join(unique, key), left.join(unique, key, "left_anti")


def multi_key_lookup(df: DataFrame, id_col: str, keys: list[str], lookup: DataFrame, lookup_key: str, value: str) -> DataFrame:
    """The value of the first of several candidate keys that the lookup has."""
    tried = df.select(id_col, F.posexplode(F.array(*(F.col(k).cast("string") for k in keys))).alias("__try", "__key")).where("__key is not null")
    hit = tried.join(lookup.select(F.col(lookup_key).cast("string").alias("__key"), value), "__key").groupBy(id_col).agg(F.min_by(value, "__try").alias(value))
    return df.join(hit, id_col, "left")


def misaligned(a: DataFrame, b: DataFrame, key: str, attribute: str) -> DataFrame:
    """Keys that only one side has or whose attribute differs; empty if the runs are aligned."""
    both = a.select(key, F.col(attribute).alias("__a"), F.lit(True).alias("__ina")).join(b.select(key, F.col(attribute).alias("__b"), F.lit(True).alias("__inb")), key, "full")
    problem = F.when(F.col("__inb").isNull(), "only_left").when(F.col("__ina").isNull(), "only_right").when(~F.col("__a").eqNullSafe(F.col("__b")), "differs")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def pairs_within(df: DataFrame, group: str, order: str) -> DataFrame:
    """All unordered pairs of a group, the smaller first; the groups must be small by nature."""
    return df.select(group, F.col(order).alias("left")).join(df.select(group, F.col(order).alias("right")), group).where("left < right")


#: Rows of a group in one tile, and pairs that a task makes.
TILE_ROWS, TASK_PAIRS = 512, 8_000_000


def paired(df: DataFrame, group: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of all pairs within a group, to be joined on ``group`` and ``tile``.

    A row of the left has one tile and a row of the right all tiles of its group, so no key has all pairs of a large
    group.  Rows are dealt by the number of pairs, as rows are few where pairs are many.
    """
    sizes = df.groupBy(*group).agg(F.count("*").alias("__n"))
    pairs = sizes.agg(F.sum(F.col("__n").cast("double") ** 2)).first()[0] or 0.0
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(-(-pairs // TASK_PAIRS)))
    counted = df.join(sizes, group).withColumn("__n", F.ceil(F.col("__n") / TILE_ROWS).cast("int"))
    left = counted.withColumn("tile", F.pmod(F.xxhash64(key), F.col("__n")).cast("int"))
    right = counted.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return tuple(side.drop("__n").repartition(parts, *group, "tile") for side in (left, right))


def consecutive_pairs(df: DataFrame, group: str, order: str) -> DataFrame:
    return df.select(group, F.col(order).alias("left"), F.lead(order).over(Window.partitionBy(group).orderBy(order)).alias("right")).where("right is not null")


def best_fuzzy_match(extracted: DataFrame, truth: DataFrame, paper: str, extraction_id: str, truth_position: str, tolerance: float = 0.02) -> DataFrame:
    """Per extraction the truth of its paper that agrees in most of dataset, metric and value; the first on ties.

    Expects dataset, metric and value on both sides; correct only if all three agree.
    """
    parts = ("dataset", "metric", "value")
    side = lambda df, key, name: df.select(paper, F.col(key).alias(f"__{name}_id"), *(F.col(c).alias(f"__{name}_{c}") for c in parts))
    e, t = side(extracted, extraction_id, "e"), side(truth, truth_position, "t")
    # Equal rows agree alike: distinct ones are compared, of equal truths the first.
    own, theirs = [f"__e_{c}" for c in parts], [f"__t_{c}" for c in parts]

    def read(df: DataFrame, n: str) -> DataFrame:
        named = df.withColumns({f"__{n}_name": X.normalize(F.col(f"__{n}_dataset")), f"__{n}_measure": X.normalize(F.col(f"__{n}_metric")), f"__{n}_number": X.numeric_value(F.col(f"__{n}_value"))})
        return named.withColumn(f"__{n}_aliased", X.aliased(F.col(f"__{n}_measure"))).repartition(paper)

    asked = read(e.select(paper, *own).distinct(), "e")
    known = read(t.groupBy(paper, *theirs).agg(F.min_by("__t_id", F.struct("__t_id")).alias("__t_id")), "t")
    e_, t_ = ([F.col(f"__{n}_{c}") for c in ("name", "measure", "aliased", "number")] for n in "et")
    agree = X.normalized_match(e_[0], t_[0]).cast("int") + X.metrics_match(e_[1], e_[2], t_[1], t_[2]).cast("int") + X.numbers_match(e_[3], t_[3], tolerance).cast("int")
    scored = asked.join(known, paper, "left").withColumn("score", F.coalesce(agree, F.lit(0)))
    order = F.struct(-F.col("score"), F.col("__t_id"))
    found = scored.groupBy(paper, *own).agg(F.min_by(F.struct("score", "__t_id"), order).alias("__best"))
    found = found.select(*(F.col(c).alias(f"__f{i}") for i, c in enumerate((paper, *own))), "__best")
    same = F.lit(True)
    for i, c in enumerate((paper, *own)):
        same = same & F.col(c).eqNullSafe(F.col(f"__f{i}"))
    joined = e.join(found, same).select(paper, F.col("__e_id").alias(extraction_id), "__best.score", F.col("__best.__t_id").alias("__t_id"))
    best = Window.partitionBy(extraction_id).orderBy(F.col("score").desc(), "__t_id")
    top = joined.withColumn("__n", F.row_number().over(best)).where("__n = 1")
    return top.select(paper, extraction_id, F.when(F.col("score") > 0, F.col("__t_id")).alias("matched"), "score", (F.col("score") == 3).alias("correct"))


def usable_features(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns with at least two distinct values, without those identical to an earlier one.

    One aggregate over the table; what comes back is one number per column and pair.
    """
    counts = df.agg(*(F.count_distinct(c).alias(f"n{i}") for i, c in enumerate(columns))).first()
    kept = [c for i, c in enumerate(columns) if counts[f"n{i}"] >= 2]
    if len(kept) < 2:
        return kept
    pairs = [(a, b) for j, b in enumerate(kept) for a in kept[:j]]
    same = df.agg(*(F.bool_and(F.col(a).eqNullSafe(F.col(b))).alias(f"s{i}") for i, (a, b) in enumerate(pairs))).first()
    doubled = {b for i, (_, b) in enumerate(pairs) if same[f"s{i}"]}
    return [c for c in kept if c not in doubled]


def feature_family(name: Column, rules: list[tuple[str, str]], other: str = "other") -> Column:
    """Family of the first rule (part of the name, family) that applies."""
    out = F.lit(other)
    for part, family in reversed(rules):
        out = F.when(name.contains(part), family).otherwise(out)
    return out


def shuffled_choices(id_col: Column, right: Column, wrong: Column) -> tuple[Column, Column]:
    """(options, letter of the right one): four options in the order of a hash of id and option."""
    options = F.transform(F.array_sort(F.transform(F.concat(F.array(right), wrong), lambda o: F.struct(F.xxhash64(id_col, o).alias("h"), o.alias("o")))), lambda s: s["o"])
    return options, F.substring(F.lit("ABCD"), F.array_position(options, right).cast("int"), F.lit(1))


def rubric_total(awards: Column, maxima: Column) -> Column:
    """Sum of awards, each kept between 0 and its maximum; missing awards count 0."""
    clamped = F.zip_with(awards, maxima, lambda a, m: F.least(F.greatest(F.coalesce(a, F.lit(0.0)), F.lit(0.0)), m))
    return F.aggregate(clamped, F.lit(0.0), lambda x, y: x + y)


def guarded_ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def assemble_traces(steps: DataFrame, scores: DataFrame, metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Steps of traces that have a score, with the trace's metrics where there are any."""
    return steps.join(scores, keys).join(metrics, keys, "left")


def collapse(df: DataFrame, key: str, columns: list[str], order: str, done: DataFrame | None = None) -> DataFrame:
    """One row per key with the first values in an order; keys that ``done`` has are left out."""
    rows = df if done is None else df.join(done.select(key), key, "left_anti")
    return rows.groupBy(key).agg(*(F.min_by(c, order).alias(c) for c in columns))


def gold_answers(df: DataFrame, id_col: str, answers: str) -> DataFrame:
    """The answer that an id of the form paper__qN names; rows whose N is out of range or missing go."""
    n = F.regexp_extract(id_col, r"__q(\d+)$", 1).try_cast("int")
    return df.withColumn("gold", F.get(answers, n)).where(n.isNotNull() & F.col("gold").isNotNull())


def record_shape(record: Column) -> Column:
    """Kind of a JSON record by the keys it has: trajectory, annotation, step or label; else other."""
    has = lambda key: F.get_json_object(record, f"$.{key}").isNotNull()
    return F.when(has("messages") | has("chat_history") | has("steps"), "trajectory").when(has("step_annotations"), "annotation").when(has("step"), "step").when(has("label"), "label").otherwise("other")


def tagged_union(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of several tables with the table's name in ``origin``; columns that a table lacks are NULL."""
    out = None
    for name, table in tables.items():
        rows = table.withColumn("origin", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def unique_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows; a key that comes twice makes the query fail."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    guarded = counts.select(*keys, F.assert_true(F.col("__n") == 1, F.concat(F.lit("duplicate key "), F.concat_ws(",", *(F.col(k).cast("string") for k in keys)))).alias("__ok")).where("__ok is null").drop("__ok")
    return df.join(guarded, keys, "left_semi")


def ramped(values: Column, step: float = 1e-6) -> Column:
    """A constant series with a tiny ramp added, as some models reject flat ones; other series as they are."""
    return F.when(F.array_max(values) == F.array_min(values), F.transform(values, lambda x, i: x + i * step)).otherwise(values)


def text_or_abstract(full: Column, abstract: Column) -> tuple[Column, Column]:
    """(text, mode): the full text where there is one, else the abstract."""
    has = F.coalesce(F.trim(full) != "", F.lit(False))
    return F.when(has, full).otherwise(abstract), F.when(has, "full_text").otherwise("abstract")
