"""Text functions without a built-in counterpart: Arrow-batched functions, made when they are first used.

The plain functions come first, so that worker processes can import them without a session.
"""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def tidy(text: str | None) -> str:
    """Compatibility decomposition, lower case, white space collapsed."""
    return " ".join(unicodedata.normalize("NFKD", text or "").lower().split())


def matching_ratio(a: str | None, b: str | None) -> float:
    """Ratio of matching blocks of two tidied texts."""
    return difflib.SequenceMatcher(None, tidy(a), tidy(b)).ratio()


def vote_form(text: str | None) -> str | None:
    """Form in which answers are counted: compatibility characters, case, white space, no punctuation at the edges."""
    if text is None:
        return None
    return " ".join(unicodedata.normalize("NFKC", text).lower().split()).strip(".,;:!?\"'()[]{} ")


def common_subsequence(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def subsequence_f(a: str | None, b: str | None) -> float:
    """F-measure of the longest common subsequence of words."""
    x, y = (a or "").lower().split(), (b or "").lower().split()
    n = common_subsequence(x, y)
    return 2 * n / (len(x) + len(y)) if n else 0.0


def _two(function):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([function(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    return run


def similarity_ratio(a: Column | str, b: Column | str) -> Column:
    return F.pandas_udf(_two(matching_ratio), "double")(a, b)


def rouge_l(a: Column | str, b: Column | str) -> Column:
    return F.pandas_udf(_two(subsequence_f), "double")(a, b)


def vote_answer(a: Column | str) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(vote_form)

    return F.pandas_udf(run, "string")(a)


def normalize_decomposed(a: Column | str) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(tidy)

    return F.pandas_udf(run, "string")(a)
