"""Agent records and model responses: messages, steps, tool calls, fenced JSON, annotations and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

MESSAGE = "struct<role: string, content: string>"
RECORD = f"struct<messages: array<{MESSAGE}>, chat_history: array<{MESSAGE}>, steps: array<struct<messages: array<{MESSAGE}>>>>"

# Parts of section names that mark sections with results, and names that always count.
RESULT_SECTIONS = ["result", "experiment", "evaluation", "performance", "comparison", "ablation", "analysis", "benchmark", "discussion", "method", "approach", "model", "baseline", "setup", "implementation"]
ALWAYS_SECTIONS = ["abstract", "title"]

# Keys under which a response may wrap its list.
WRAPPERS = ["results", "extractions", "tuples", "data"]

# Expected level of each extracted field.
EXPECTED_LEVEL = {"method": 1, "dataset": 1, "metric": 1, "value": 2, "year": 2}


def relevant_section(name: Column) -> Column:
    """Whether a section is likely to hold results."""
    lower = F.lower(name)
    return lower.isin(ALWAYS_SECTIONS) | lower.rlike("|".join(RESULT_SECTIONS))


def agent_messages(record: Column) -> Column:
    """Ordered messages of a JSON record: its messages, else its chat history, else the messages of its steps."""
    parsed = F.from_json(record, RECORD)
    filled = lambda c: F.when(F.size(c) > 0, c)
    nested = F.flatten(F.transform(parsed["steps"], lambda s: s["messages"]))
    return F.coalesce(filled(parsed["messages"]), filled(parsed["chat_history"]), filled(nested))


def step_chunk(content: Column, calls: Column) -> Column:
    """Text of a step: its content and its rendered tool calls (array of name and arguments); NULL if both are empty."""
    rendered = F.concat(F.lit("Tool calls: "), F.array_join(F.transform(calls, lambda c: F.concat(F.coalesce(c["name"], F.lit("tool")), F.lit("("), F.coalesce(c["arguments"], F.lit("")), F.lit(")"))), " | "))
    parts = F.filter(F.array(strip(content), F.when(F.size(calls) > 0, rendered)), lambda p: F.coalesce(p, F.lit("")) != "")
    return F.when(F.size(parts) > 0, F.array_join(parts, "\n"))


def reasoning_steps(response: Column) -> tuple[Column, Column]:
    """(steps, answer) of a response with 'Step n:' marks and 'ANSWER:'.

    Without marks the text is cut at numbered lines, else at blank lines; without an answer mark the last line is the answer.
    """
    has = response.rlike(r"ANSWER:")
    before = strip(F.when(has, F.regexp_extract(response, r"(?s)^(.*?)ANSWER:", 1)).otherwise(response))
    answer = F.when(has, strip(F.regexp_extract(response, r"(?s)ANSWER:\s*(.*)", 1))).otherwise(strip(F.element_at(F.split(before, "\n"), -1)))
    cut = lambda pattern: F.filter(F.transform(F.split(before, pattern), lambda p: strip(p)), lambda p: p != "")
    marks = r"(?i)Step\s+\d+\s*[:.]"
    pieces = F.split(before, marks)
    marked = F.filter(F.transform(F.when(F.size(pieces) > 1, F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(1)))).otherwise(pieces), lambda p: strip(p)), lambda p: p != "")
    numbered, blank = cut(r"\n\s*\d+[.)]\s+"), cut("\n\n")
    return F.when(F.size(marked) > 1, marked).when(F.size(numbered) > 1, numbered).otherwise(blank), answer


def fenced_rows(response: Column, row: str) -> Column:
    """Array of records of a response: a JSON list or object, fenced or wrapped or both; else the first bracketed part that parses; else empty.

    ``row`` is the record's type, struct<...>.
    """
    text = strip(F.regexp_replace(F.regexp_replace(strip(response), r"^```[^\n]*\n", ""), r"\n\s*```\s*$", ""))
    as_list = lambda t: F.from_json(t, f"array<{row}>", {"mode": "PERMISSIVE"})
    listed = F.when(text.startswith("["), as_list(text))
    wrapped = F.coalesce(*(as_list(F.get_json_object(text, f"$.{k}")) for k in WRAPPERS))
    single = F.when(text.startswith("{") & F.get_json_object(text, "$").isNotNull(), F.array(F.from_json(text, row)))
    rescued = as_list(F.nullif(F.regexp_extract(text, r"(?s)(\[.*\])", 1), F.lit("")))
    known = F.coalesce(listed, wrapped, single, rescued)
    return F.coalesce(known, F.array().cast(f"array<{row}>"))


def critical_error(module: Column, annotations: Column) -> Column:
    """struct(module, error_type, reasoning) of the first step annotation that has one: the named module, else the first other one.

    annotations: array of JSON objects with a key per module.
    """
    payload = "struct<failure_type: string, reasoning: string>"
    entries = F.flatten(F.transform(annotations, lambda a: F.map_entries(F.from_json(a, "map<string,string>"))))
    usable = F.filter(entries, lambda e: (e["key"] != "step") & e["value"].startswith("{"))
    named = F.filter(usable, lambda e: e["key"] == module)
    chosen = F.when(F.size(named) > 0, F.get(named, F.lit(0))).otherwise(F.get(usable, F.lit(0)))
    parsed = F.from_json(chosen["value"], payload)
    return F.struct(F.coalesce(chosen["key"], module).alias("module"), parsed["failure_type"].alias("error_type"), parsed["reasoning"].alias("reasoning"))


def usage(response: Column) -> dict[str, Column]:
    """Token counts and finish reason of a JSON response."""
    number = lambda path: F.get_json_object(response, path).try_cast("bigint")
    status = F.get_json_object(response, "$.status")
    reason = F.get_json_object(response, "$.incomplete_details.reason")
    return {
        "input_tokens": number("$.usage.input_tokens"),
        "output_tokens": number("$.usage.output_tokens"),
        "reasoning_tokens": number("$.usage.output_tokens_details.reasoning_tokens"),
        "finish_reason": F.when(status == "completed", "stop").when(status == "incomplete", F.coalesce(reason, F.lit("incomplete"))).otherwise(status),
    }


def drift_features(realized: Column, probabilities: list[Column]) -> dict[str, Column]:
    """Distance of a realized level from each field's expected one, mean and largest, and the entropy (nats) of the probabilities."""
    fields = {k: F.abs(F.lit(v) - realized) for k, v in EXPECTED_LEVEL.items()}
    lifted = [p + 1e-10 for p in probabilities]
    whole = sum(lifted[1:], lifted[0])
    entropy = -sum((p / whole * F.log(p / whole) for p in lifted), F.lit(0.0))
    return {"drift_mean": sum(fields.values(), F.lit(0)) / len(fields), "drift_max": F.greatest(*fields.values()), "drift_value": fields["value"], "drift_method": fields["method"], "level_entropy": entropy}


def first_positive(df: DataFrame, keys: list[str], step: str, flag: str) -> DataFrame:
    """First flagged step of prefixes judged one after the other, and how many were judged until then."""
    marked = df.withColumn("__hit", F.min(F.when(F.col(flag), F.col(step))).over(Window.partitionBy(*keys)))
    return marked.groupBy(*keys).agg(F.min("__hit").alias("first_step"), F.count_if(F.col("__hit").isNull() | (F.col(step) <= F.col("__hit"))).alias("judged"))


def predicted_step(df: DataFrame, trace: str, step: str, probability: str) -> DataFrame:
    """Step of the highest probability per trace, the earliest on ties."""
    w = Window.partitionBy(trace).orderBy(F.col(probability).desc(), step)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def model_wins(scores: DataFrame, run: str, model: str, value: str, a: str, b: str, delta: float = 0.03, needed: int = 3) -> DataFrame:
    """Per run the difference of two models and a verdict; carried says whether enough runs were won."""
    per = scores.groupBy(run).agg(F.max(F.when(F.col(model) == a, F.col(value))).alias("a"), F.max(F.when(F.col(model) == b, F.col(value))).alias("b"))
    change = F.col("a") - F.col("b")
    judged = per.select(run, change.alias("difference"), F.when(change >= delta, "win").when(change <= -delta, "regress").otherwise("inconclusive").alias("verdict"))
    carried = judged.agg((F.count_if(F.col("verdict") == "win") >= needed).alias("carried"))
    return judged.crossJoin(F.broadcast(carried))
