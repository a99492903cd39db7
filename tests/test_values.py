"""Filters, windows, display text and small column functions."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from salesloom.functions import numeric, text
from salesloom.plans import filters


def value(spark, column, **cells):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cells.items()] or [F.lit(0).alias("_")])
    return frame.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "amount,shown",
    [
        (1234567.0, "$1.23M"),
        (-1234567.0, "-$1.23M"),
        (1500.0, "$1.5K"),
        (999.999, "$1000.00"),
        (-0.5, "-$0.50"),
        (0.0, "$0.00"),
        (None, "—"),
        (float("nan"), "—"),
    ],
)
def test_compact_money(spark, amount, shown):
    assert value(spark, text.compact_money(F.lit(amount).cast("double"))) == shown


def test_texts(spark):
    assert value(spark, text.percent_text(F.lit(12.345))) == "12.3%"
    assert value(spark, text.percent_text(F.lit(None).cast("double"))) == "—"
    assert value(spark, text.count_text(F.lit(1234567))) == "1,234,567"
    assert value(spark, text.profit_text(F.lit(-3.456))) == "$3.46"
    assert value(spark, text.profit_text(F.lit(0.0))) == "+$0.00"
    assert [value(spark, text.profit_level(F.lit(v).cast("double"))) for v in (0.0, -1.0, None)] == ["success", "danger", "muted"]
    assert value(spark, text.level_of(F.lit("Same Day"), text.SHIP_MODE_LEVELS)) == "danger"
    assert value(spark, text.level_of(F.lit("Drone"), text.SHIP_MODE_LEVELS)) == "muted"


@pytest.mark.parametrize("x,digits,expected", [(1.005, 2, 1.01), (0.285, 2, 0.29), (3.75, 1, 3.8), (-3.75, 1, -3.8), (6.25, 1, 6.3)])
def test_rounding_is_half_up(spark, x, digits, expected):
    assert value(spark, numeric.rounded(F.lit(x), digits)) == expected


def test_numbers(spark):
    assert value(spark, numeric.ratio(F.lit(1), F.lit(0))) is None
    assert value(spark, numeric.ratio_or_zero(F.lit(5.0), F.lit(-2.0))) == 0.0
    assert [value(spark, numeric.net_status(F.lit(v))) for v in (0.004, 0.0, -0.004)] == ["PROFIT", "BREAK EVEN", "LOSS"]
    assert value(spark, numeric.bubble_radius(F.lit(4.0))) == 5.0
    assert value(spark, numeric.bubble_radius(F.lit(100.0))) == 12.0
    assert value(spark, numeric.bubble_radius(F.lit(None).cast("double"))) == 5.0
    assert value(spark, numeric.bar_width(F.lit(-250.0))) == 100.0
    start, end = (F.lit(t).cast("timestamp_ntz") for t in ("2014-12-31 13:30:00", "2015-01-02 01:30:00"))
    assert value(spark, numeric.fractional_days(start, end)) == 1.5


def test_windows():
    assert filters.preset_window("all", "2011-01-01", "2014-12-31") == (date(2011, 1, 1), date(2014, 12, 31))
    assert filters.preset_window("2013", "2011-01-01", "2014-12-31") == (date(2013, 1, 1), date(2013, 12, 31))
    assert filters.preset_window("q4_2014", "2011-01-01", "2014-12-31") == (date(2014, 10, 1), date(2014, 12, 31))
    with pytest.raises(ValueError):
        filters.preset_window("q5_2014", "2011-01-01", "2014-12-31")
    for bad in (("", "2014-01-01"), ("2014-01-01", None), ("2014-02-01", "2014-01-01")):
        with pytest.raises(ValueError):
            filters.validate_window(*bad)


def test_steps():
    low, high = "2011-01-01", "2014-12-31"
    assert filters.step_day("2014-12-30", 1, low, high) == date(2014, 12, 31)
    assert filters.step_day("2014-12-31", 1, low, high) == date(2014, 12, 31)
    assert filters.step_day("2011-01-01", -1, low, high) == date(2011, 1, 1)


def test_filter_cleans_its_values():
    assert filters.Filter(" ", "", None, "  EU ").columns == {"market"}
    assert filters.Filter(market=" EU ").market == "EU"
    assert filters.Filter(date_end="2014-12-31").columns == {"order_date"}
