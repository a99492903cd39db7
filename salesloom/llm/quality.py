"""Operator 1: quality rules, a threshold table compiled into one projection.

Everything is computed inside the row, so the job is one scan without a shuffle
and without user functions. The only step that is not a plain count is finding
word windows that occur twice: each window becomes one whole number made of a
hash (high part) and its position (low part), so that sorting the numbers brings
equal windows together and still tells where they were. Neighbours with equal
hash parts are compared word by word before they count.

Defined results: a null text has no words and fails the base rule; an empty text
likewise; very long texts are measured whole; repeated rows give repeated rows;
an empty table gives an empty table; extra columns of any name pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.llm.columns import packed, settled, unpacked, words

WINDOW = 3
# A window's code: its hash rounded down to a multiple of the word count, plus its position.
CODES = """
transform(slice(found, 1, greatest(n_words - 2, 0)),
          (w, i) -> (shiftrightunsigned(xxhash64(w, get(found, i + 1), get(found, i + 2)), 1) div n_words) * n_words + i)
"""


def _same(other: str) -> str:
    """Whether a sorted code and its neighbour stand for equal words."""
    here, there = "int(c % n_words)", f"int({other} % n_words)"
    equal = " and ".join(f"get(found, {here} + {k}) = get(found, {there} + {k})" for k in range(WINDOW))
    return f"(c div n_words = {other} div n_words and {equal})"


# Most texts repeat nothing, which sorted codes further apart than the word count show at little cost.
REPEATED = f"""
if(exists(transform(codes, (c, j) -> get(codes, j + 1) - c < n_words), near -> near), transform(filter(codes, (c, j) -> coalesce({_same("get(codes, j - 1)")}, false)
                                  or coalesce({_same("get(codes, j + 1)")}, false)),
          c -> c % n_words), array())
"""
# Words covered by the windows that begin at `starts`: each start adds what the next one leaves it.
COVERED = f"""
aggregate(transform(starts, (p, k) -> least({WINDOW}L, coalesce(get(starts, k + 1) - p, {WINDOW}L))), 0L, (a, x) -> a + x)
"""
SYMBOLS = r"[#*$%&|<>]"
HAS_WORD = r"[^\x20\x09-\x0D]"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = tuple(
    """
    the of and to a in that is it with for on are as be this from by was at or have not
    le la les de des du et en un une que qui dans pour par sur au est avec plus pas
    der die das und in zu den von mit ist ein eine auf für sich nicht dem als auch
    el los las y que en del por un una se con para no es al lo como su más
    """.split()
)


@dataclass(frozen=True)
class Rule:
    """A document passes while `low` <= 100 * measure / of <= `high`; None is no bound."""

    name: str
    measure: str
    of: str
    low: int | None = None
    high: int | None = None


# The base of the contract: too short, or mostly repeated windows.
BASE = (
    Rule("short", "n_words", "hundred", low=50),
    Rule("repeats", "n_repeat_words", "n_words", high=50),
)
# The method's own thresholds, in percent.
RULES = (
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("stop_words", "n_stop_words", "n_words", low=6),
    Rule("mean_word", "word_chars", "n_words", low=200, high=1500),
    Rule("lines", "n_dup_lines", "n_lines", high=70),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines")


def verdict(rules: tuple[Rule, ...], measure) -> Column:
    """True where a row breaks one of the rules; `measure` gives the column of a name."""
    broken = F.lit(False)
    for r in rules:
        value, of = F.lit(100) * measure(r.measure), measure(r.of)
        if r.low is not None:
            broken = broken | (value < F.lit(r.low) * of)
        if r.high is not None:
            broken = broken | (value > F.lit(r.high) * of)
    return broken


def quality(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    base: tuple[Rule, ...] = BASE,
    text: str = "text",
    stop_words: tuple[str, ...] = STOP_WORDS,
    out: str = "quality",
) -> DataFrame:
    """The documents with a struct column `out`: the measures, base_failed, kept, and which rules broke."""
    spelled = tuple(dict.fromkeys([*stop_words, *(w.capitalize() for w in stop_words)]))
    measured = _measured(packed(docs, text=text), spelled)

    def measure(name: str) -> Column:
        return F.lit(100).cast("long") if name == "hundred" else F.col(name)

    broken = F.array_compact(
        F.array(*[F.when(verdict((r,), measure), F.lit(r.name)) for r in (*base, *rules)])
    )
    failed = verdict(base, measure)
    judged = F.struct(
        *MEASURES,
        failed.alias("base_failed"),
        (~failed & ~verdict(rules, measure)).alias("kept"),
        broken.alias("broken"),
    )
    return unpacked(settled(measured, "row", judged=judged), docs.columns, **{out: "judged"})


def _measured(rows: DataFrame, stop_words: tuple[str, ...]) -> DataFrame:
    rows = rows.withColumns({"found": words(F.col("text")), "lines": _lines(F.col("text"))})
    rows = rows.withColumn("n_words", F.size("found").cast("long"))
    rows = rows.withColumn("codes", F.sort_array(F.expr(CODES)))
    rows = rows.withColumn("starts", F.sort_array(F.expr(REPEATED)))
    return rows.select(
        "row",
        "n_words",
        F.length(F.array_join("found", "")).cast("long").alias("word_chars"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(COVERED).alias("n_repeat_words"),
        F.size(F.filter("found", lambda w: w.isin(*stop_words))).cast("long").alias("n_stop_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(HAS_WORD))
