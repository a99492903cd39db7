"""Dashboard filter, date windows and day stepping."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.functions.numeric import as_column


# Texts of the two window errors.
MISSING_DATES = "Please provide both valid start and end dates."
DATES_REVERSED = "Invalid date range: Start date ({start}) is after End date ({end})."


def _clean(value) -> str:
    return "" if value is None else str(value).strip()


def _day(value) -> date:
    return date.fromisoformat(str(value).strip()[:10])


def _instant(day: date) -> Column:
    return F.lit(day.isoformat()).cast("timestamp_ntz")


def from_day(column, day) -> Column:
    """At or after the start of a day; a plain comparison, so parquet can skip."""
    return as_column(column) >= _instant(_day(day))


def through_day(column, day) -> Column:
    """Up to the end of a day, whatever the time part."""
    return as_column(column) < _instant(_day(day) + timedelta(days=1))


@dataclass(frozen=True)
class Filter:
    """Optional order-date range, region and market; blank means not filtered."""

    date_start: str | date | None = None
    date_end: str | date | None = None
    region: str | None = None
    market: str | None = None

    def __post_init__(self):
        for name in ("date_start", "date_end", "region", "market"):
            object.__setattr__(self, name, _clean(getattr(self, name)) or None)

    @property
    def columns(self) -> set[str]:
        used = {name for name in ("region", "market") if getattr(self, name)}
        return used | ({"order_date"} if self.date_start or self.date_end else set())

    def on_dates(self, frame: DataFrame) -> DataFrame:
        if self.date_start:
            frame = frame.where(from_day("order_date", self.date_start))
        if self.date_end:
            frame = frame.where(through_day("order_date", self.date_end))
        return frame

    def on_years(self, frame: DataFrame) -> DataFrame:
        """What the dates say of a year column: a coarser range, for rows whose date comes only by a join."""
        if self.date_start:
            frame = frame.where(F.col("year") >= _day(self.date_start).year)
        if self.date_end:
            frame = frame.where(F.col("year") <= _day(self.date_end).year)
        return frame

    def on_locations(self, frame: DataFrame) -> DataFrame:
        for name in ("region", "market"):
            value = getattr(self, name)
            if value:
                frame = frame.where(F.col(name) == F.lit(value))
        return frame

    def apply(self, frame: DataFrame) -> DataFrame:
        return self.on_locations(self.on_dates(frame))


NO_FILTER = Filter()


def on_day(frame: DataFrame, day, column: str = "order_date") -> DataFrame:
    return frame.where(from_day(column, day) & through_day(column, day))


def in_window(frame: DataFrame, start, end, column: str = "order_date") -> DataFrame:
    """Rows inside an inclusive window; rows without a date drop out."""
    first, last = validate_window(start, end)
    return frame.where(from_day(column, first) & through_day(column, last))


def validate_window(start, end) -> tuple[date, date]:
    if not _clean(start) or not _clean(end):
        raise ValueError(MISSING_DATES)
    first, last = _day(start), _day(end)
    if first > last:
        raise ValueError(DATES_REVERSED.format(start=first, end=last))
    return first, last


def preset_window(name: str, low, high) -> tuple[date, date]:
    """``all``, a year such as ``1997``, or a quarter such as ``q4_1997``."""
    wanted = _clean(name).lower()
    if wanted == "all":
        return validate_window(low, high)
    shape = re.fullmatch(r"(?:q([1-4])_)?(\d{4})", wanted)
    if not shape:
        raise ValueError(f"unknown window preset {name!r}")
    year = int(shape.group(2))
    if not shape.group(1):
        return date(year, 1, 1), date(year, 12, 31)
    last_month = int(shape.group(1)) * 3
    return date(year, last_month - 2, 1), date(year, last_month, calendar.monthrange(year, last_month)[1])


def step_day(day, delta: int, low, high) -> date:
    moved = _day(day) + timedelta(days=delta)
    return max(_day(low), min(_day(high), moved))


def step_day_column(day, delta: int, low, high) -> Column:
    floor, ceiling = F.lit(_day(low)), F.lit(_day(high))
    return F.greatest(floor, F.least(ceiling, F.date_add(F.to_date(as_column(day)), delta)))
