"""Quality rules: a threshold table compiled into one projection of length, symbol, stop-word and line ratios.

Everything is a built-in expression over one row: no user functions, no shuffle,
and the plan is a scan with projections.  Words are the longest runs without the
bytes 0x20 and 0x09 to 0x0D.

Repeated windows are found without a row per window: words are hashed once, a
window's hash is taken from its words' hashes, and only where two windows of a
text share a hash are they sorted by it; neighbours count as equal when their
words are.  That is linear in the text but for the sort.

Defined results: a null text has no words and fails the base rules, like an
empty one; rows without an id are judged like others and repeated rows one by
one; a ratio without a denominator is 0; an empty table gives an empty one; the
further columns of the table are not looked at and may have any names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a window, base thresholds: least words, and the most of them, in a hundred, that repeated windows may hold.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30

# Characters that end a word, characters that count as symbols, and frequent function words of English,
# German, French and Spanish.
GAP = " \t\n\x0b\f\r"
GAP_PATTERN = r"[\x20\x09-\x0D]+"
WORD_PATTERN = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
STOP_WORDS = (
    "a an and are as at be by for from has have he her his i in is it not of on or she that the their they this to was we were which with you "
    "aber als am an auf aus bei das dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nicht sich sie sind und von war zu zur "
    "au aux ce dans de des du elle en est et il je la le les leur mais ne nous on ou par pas pour que qui sa se ses son sur un une vous "
    "al como con de del el ella en es esta fue la las lo los más no o para pero por que se sin su sus un una y"
).split()


@dataclass(frozen=True)
class Rule:
    """A bound on a count, or on a ratio of two counts, for texts of at least ``words`` words."""

    name: str
    count: str
    per: str | None = None
    low: float | None = None
    high: float | None = None
    words: int = 0


#: The threshold table.  Counts are those of ``COUNTS``.
RULES = (
    Rule("too_long", "n_words", high=1_000_000),
    Rule("word_length", "word_chars", "n_words", low=2.0, high=16.0),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("exclamations", "n_exclamations", "n_words", high=0.2),
    Rule("capitals", "n_capitals", "word_chars", high=0.4),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02, words=50),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.3, words=50),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=0.3),
)

_lines_like = lambda pattern: lambda lines: F.size(F.filter(lines, lambda line: line.rlike(pattern))).cast("bigint")
#: Patterns of whole lines, shared with the SQL.
BULLET_LINE, ELLIPSIS_LINE = r"^[ \t]*(•|●|‣|-|\*)[ \t]", r"(\.\.\.|…)[ \t\r]*$"


def _counted(text: Column, words: Column, lines: Column, stop_words: list[str]) -> dict[str, Column]:
    """The counts that a look at each word or line gives."""
    return {
        "n_words": F.size(words).cast("bigint"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("bigint"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        "n_exclamations": F.regexp_count(text, F.lit("[!?]")).cast("bigint"),
        "n_capitals": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("bigint"),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(stop_words))).cast("bigint"),
        "n_lines": F.size(lines).cast("bigint"),
        "n_bullet_lines": _lines_like(BULLET_LINE)(lines),
        "n_ellipsis_lines": _lines_like(ELLIPSIS_LINE)(lines),
    }


#: Names that a rule's ``count`` and ``per`` can have.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_exclamations", "n_capitals", "n_stop_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines")


def compiled(rules: tuple[Rule, ...] = RULES, column: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """One boolean expression per rule: whether it fails."""
    out = {}
    for rule in rules:
        unknown = {rule.count, rule.per or rule.count} - set(COUNTS)
        if unknown or rule.name in out:
            raise ValueError(f"rule {rule.name} counts {sorted(unknown)}, which nothing gives" if unknown else f"two rules named {rule.name}")
        value = column(rule.count).cast("double")
        if rule.per:
            value = F.when(column(rule.per) > 0, value / column(rule.per)).otherwise(0.0)
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | (value < rule.low)
        if rule.high is not None:
            bad = bad | (value > rule.high)
        out[rule.name] = bad & (column("n_words") >= rule.words)
    return out


def compiled_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same verdict as a SQL condition over the counts: true if any rule fails."""
    parts = []
    for rule in rules:
        value = f"(CASE WHEN {rule.per} > 0 THEN {rule.count}::DOUBLE / {rule.per} ELSE 0.0 END)" if rule.per else f"{rule.count}::DOUBLE"
        bounds = ([f"{value} < {rule.low}"] if rule.low is not None else []) + ([f"{value} > {rule.high}"] if rule.high is not None else [])
        parts.append(f"(({' OR '.join(bounds)}) AND n_words >= {rule.words})")
    return " OR ".join(parts)


def _repeated_words(df: DataFrame, words: str, out: str, width: int) -> DataFrame:
    """Adds the number of words that lie in windows which the text holds twice or more.

    Each step is a projection of its own and names its input more than once, so that the optimizer doesn't put an
    array's expression into the body of a function that runs for each element.
    """
    low = F.col("__low")

    def next_to(x: Column, i: Column) -> Column:
        """Whether entry i is the same window as x: of equal hash bits, and of equal words."""
        y = F.get(F.col("__sorted"), i)
        from_ = lambda e: F.slice(F.col(words), e.bitwiseAND(low).cast("int") + 1, width)
        return F.coalesce(x.bitwiseXOR(y).between(0, low) & (from_(x) == from_(y)), F.lit(False))

    rest, none = [c for c in df.columns if c != words], F.array().cast("array<bigint>")
    df = df.select(*rest, words, F.when(F.size(words) > width, F.transform(words, lambda w: F.xxhash64(w))).otherwise(none).alias("__hashes"))
    joined = 1
    while joined < width:  # hashes of so many words, from each word on, which are padded at the end
        step = min(joined, width - joined)
        shifted = F.slice(F.col("__hashes"), step + 1, F.greatest(F.size("__hashes") - step, F.lit(0)))
        df = df.select(*rest, words, F.zip_with("__hashes", shifted, lambda x, y: F.xxhash64(x, y)).alias("__hashes"))
        joined += step
    df = df.select(*rest, words, F.slice(F.col("__hashes"), 1, F.greatest(F.size("__hashes") - (width - 1), F.lit(0))).alias("__windows"))
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    # The lower bits of an entry are the window's place, the others are of its hash: numbers sort faster than pairs.
    df = df.select(*rest, words, "__windows", repeats.alias("__repeats"), (F.pow(F.lit(2.0), F.ceil(F.log2(F.size("__windows") + 1))).cast("bigint") - 1).alias("__low"))
    packed = F.transform("__windows", lambda h, i: h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("bigint")))
    df = df.select(*rest, words, "__low", F.when(F.col("__repeats"), F.sort_array(packed)).otherwise(none).alias("__sorted"))
    twice = F.filter("__sorted", lambda x, i: next_to(x, i - 1) | next_to(x, i + 1))
    df = df.select(*rest, F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(low).cast("int"))).alias("__places"))
    add = lambda s, p: F.struct((s["n"] + p + width - F.greatest(s["end"], p)).alias("n"), (p + width).alias("end"))
    total = F.aggregate("__places", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), add, lambda s: s["n"])
    return df.select(*rest, total.cast("bigint").alias(out))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text", stop_words: list[str] = STOP_WORDS, width: int = WINDOW, least_words: int = LEAST_WORDS, most_repeated: int = MOST_REPEATED) -> DataFrame:
    """One row per row of docs: its id, all counts, base_failed, the names of the rules it fails, and kept."""
    if id_col in (*COUNTS, "base_failed", "failed_rules", "kept"):
        raise ValueError(f"the id column can't be named {id_col}")
    whole = F.coalesce(F.col(text_col), F.lit(""))
    body = F.btrim(F.col("__text"), F.lit(GAP))
    df = docs.select(F.col(id_col), whole.alias("__text"))
    df = df.select(
        id_col, "__text",
        F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, GAP_PATTERN, -1)).alias("__words"),
        F.filter(F.split("__text", "\n", -1), lambda line: line.rlike(WORD_PATTERN)).alias("__lines"),
    )
    counts = _counted(F.col("__text"), F.col("__words"), F.col("__lines"), list(stop_words))
    df = df.select(id_col, "__words", *(c.alias(name) for name, c in counts.items()))
    df = _repeated_words(df, "__words", "n_repeat_words", width)
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    fails = [F.when(bad, F.lit(name)) for name, bad in compiled(rules).items()]
    df = df.select(id_col, *COUNTS, base.alias("base_failed"), F.array_compact(F.array(*fails)).alias("failed_rules"))
    return df.select(id_col, *COUNTS, "base_failed", "failed_rules", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"))
