"""Display text: currency, counts, dates, badges, and text search."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.functions.numeric import as_column

DASH = "—"

# Badge level per enum value.
SEGMENT_LEVELS = {"Consumer": "info", "Corporate": "purple", "Home Office": "cyan"}
PRIORITY_LEVELS = {"Critical": "danger", "High": "warning", "Medium": "info", "Low": "muted"}
SHIP_MODE_LEVELS = {
    "Same Day": "danger",
    "First Class": "warning",
    "Second Class": "info",
    "Standard Class": "muted",
}


def fixed(value, digits: int) -> Column:
    """A number with exactly ``digits`` decimals, half-up."""
    exact = F.round(as_column(value).cast("decimal(28,10)"), digits)
    return exact.cast(f"decimal(28,{digits})").cast("string")


def compact_money(value, prefix: str = "$") -> Column:
    amount = as_column(value).cast("double")
    size = F.abs(amount)
    number = (
        F.when(size >= 1e6, F.concat(fixed(size / F.lit(1e6), 2), F.lit("M")))
        .when(size >= 1e3, F.concat(fixed(size / F.lit(1e3), 1), F.lit("K")))
        .otherwise(fixed(size, 2))
    )
    sign = F.when(amount < 0, "-").otherwise("")
    shown = F.concat(sign, F.lit(prefix), number)
    return F.when(amount.isNull() | F.isnan(amount), F.lit(DASH)).otherwise(shown)


def percent_text(value) -> Column:
    return F.coalesce(F.concat(fixed(value, 1), F.lit("%")), F.lit(DASH))


def count_text(value) -> Column:
    return F.coalesce(F.format_number(as_column(value), 0), F.lit(DASH))


def day_text(value) -> Column:
    """ISO day of a date or zone-less timestamp, null kept."""
    return F.date_format(as_column(value), "yyyy-MM-dd")


def date_text(value) -> Column:
    return F.coalesce(day_text(value), F.lit(DASH))


def profit_level(value) -> Column:
    amount = as_column(value)
    return F.when(amount.isNull(), "muted").when(amount >= 0, "success").otherwise("danger")


def profit_text(value) -> Column:
    """Amount with a plus when not negative; the level carries the minus."""
    amount = as_column(value)
    sign = F.when(amount >= 0, "+").otherwise("")
    return F.coalesce(F.concat(sign, F.lit("$"), fixed(F.abs(amount), 2)), F.lit(DASH))


def level_of(value, levels: dict[str, str], default: str = "muted") -> Column:
    source = as_column(value)
    chain = reduce(
        lambda acc, item: acc.when(source == item[0], item[1]),
        list(levels.items())[1:],
        F.when(source == next(iter(levels)), levels[next(iter(levels))]),
    )
    return chain.otherwise(default)


def ascii_lower(value) -> Column:
    return F.translate(as_column(value), string.ascii_uppercase, string.ascii_lowercase)


def matches(value, text: str) -> Column:
    """Substring match, ASCII case-insensitive; ``%`` and ``_`` are wildcards."""
    folded = text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    # No escape character exists in the search text, so name one it lacks.
    escape = next(chr(code) for code in range(1, 32) if chr(code) not in folded)
    return F.like(ascii_lower(value), F.lit(f"%{folded}%"), F.lit(escape))


def search(frame: DataFrame, text: str | None, columns: list[str]) -> DataFrame:
    """Rows where any of the columns contains the text; blank keeps all rows."""
    wanted = (text or "").strip()
    if not wanted:
        return frame
    return frame.where(reduce(lambda a, b: a | b, [matches(c, wanted) for c in columns]))
