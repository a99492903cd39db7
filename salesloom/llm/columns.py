"""Keeping an operator's own columns apart from whatever columns a table brings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"  # separates words: blank, tab to carriage return


def packed(frame: DataFrame, **named: str | Column) -> DataFrame:
    """The frame's rows folded into one struct column `row`, beside named columns.

    The names of `named` cannot clash with columns of the frame: those are inside `row`.
    """
    row = F.struct(*[F.col(_quoted(c)) for c in frame.columns]).alias("row")
    return frame.select(row, *[_column(c).alias(n) for n, c in named.items()])


def unpacked(frame: DataFrame, names: list[str], **added: str) -> DataFrame:
    """The rows of `packed` again; `added` (new name = column) replaces a clashing column."""
    kept = [F.col("row").getField(c).alias(c) for c in names if c not in added]
    return frame.select(*kept, *[F.col(c).alias(n) for n, c in added.items()])


def settled(frame: DataFrame, *kept: str, **named: Column) -> DataFrame:
    """The frame's `kept` columns and named ones that are computed once per row.

    A later filter on a plain projection is pushed below it with the column's
    whole expression, which evaluates that again, even per element inside a
    lambda. What a generator gives is not pushed.
    """
    values = F.struct(*[c.alias(n) for n, c in named.items()])
    return frame.select(*kept, F.inline(F.array(values)))


def words(text: Column) -> Column:
    """Words between white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _column(c: str | Column) -> Column:
    return F.col(_quoted(c)) if isinstance(c, str) else c


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
