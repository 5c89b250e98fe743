"""Named queries over the tables, each with its SQL where SQL expresses it."""

from . import attempt_queries, evaluation_queries, function_queries, model_queries, record_queries, retrieval_queries, text_queries, trace_queries  # noqa: F401
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
