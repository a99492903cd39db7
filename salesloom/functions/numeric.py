"""Exact money arithmetic, guarded division and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 4)
FRACTION = T.DecimalType(6, 4)

# Wide enough that a quotient keeps ten decimals before it is rounded.
_ROUNDING = "decimal(28,10)"


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def rounded(value, digits: int) -> Column:
    """Half-up rounding of a double, done in decimal so that ties are ties."""
    return F.round(as_column(value).cast(_ROUNDING), digits).cast("double")


def money(total, digits: int = 2) -> Column:
    """Round an exact decimal amount and hand it out as a double."""
    return F.round(as_column(total), digits).cast("double")


def ratio(numerator, denominator) -> Column:
    """Double quotient; null where the divisor is null or zero."""
    return F.try_divide(as_column(numerator).cast("double"), as_column(denominator).cast("double"))


def ratio_or_zero(numerator, denominator, scale: float = 1.0) -> Column:
    """``scale * numerator / denominator``; 0 unless the divisor is above zero."""
    top, bottom = as_column(numerator).cast("double"), as_column(denominator).cast("double")
    return F.when(bottom > 0, F.try_divide(top, bottom) * F.lit(scale)).otherwise(F.lit(0.0))


def percent(part, whole, digits: int) -> Column:
    return rounded(ratio(part, whole) * F.lit(100.0), digits)


def unit_price(sales="sales", quantity="quantity") -> Column:
    return ratio(sales, quantity)


def fractional_days(start, end) -> Column:
    """Days between two zone-less timestamps, counting the time of day."""

    def seconds(c: Column) -> Column:
        return F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)

    first, last = as_column(start), as_column(end)
    whole = F.datediff(F.to_date(last), F.to_date(first))
    return whole.cast("double") + (seconds(last) - seconds(first)).cast("double") / F.lit(86400.0)


def bubble_radius(price) -> Column:
    """Marker size of a sub-category in the quantity against revenue chart."""
    return F.greatest(F.lit(5.0), F.coalesce(F.sqrt(as_column(price)), F.lit(0.0)) * F.lit(1.2))


def net_status(amount) -> Column:
    value = as_column(amount)
    return F.when(value > 0, "PROFIT").when(value == 0, "BREAK EVEN").when(value < 0, "LOSS")


def margin_percent(profit, sales) -> Column:
    return ratio_or_zero(profit, sales, 100.0)


def bar_width(margin) -> Column:
    return F.least(F.abs(as_column(margin)), F.lit(100.0))


def discount_money(sales, discount_percent) -> Column:
    return as_column(sales).cast("double") * as_column(discount_percent).cast("double") / F.lit(100.0)
