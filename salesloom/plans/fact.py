"""Joins of the star, restricted to the columns a query uses.

Two grains matter. ``lines`` is one row per order line. ``order_totals`` is one
row per order: the lines are summed per order *before* the header join, which
collapses an oversized order on the map side, turns a distinct count of orders
into a plain count, and leaves the join with unique keys on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.functions.numeric import money, ratio, rounded, unit_price
from salesloom.functions.text import matches
from salesloom.plans.filters import NO_FILTER, Filter
from salesloom.sources.star import (
    CUSTOMER_COLUMNS,
    LOCATION_COLUMNS,
    ORDER_COLUMNS,
    PRODUCT_COLUMNS,
    SCHEMA,
    UNITS_PER_ONE,
    Star,
    conform,
)

# Asked for as a column, it tells lines whose product exists from the others.
STOCKED = "_stocked"
# The same for orders: whether their customer and their location exist.
KNOWN, PLACED = "_known", "_placed"
# Whether a row of the table matches a search; computed below the joins.
HITS = {t: f"_hit_{t}" for t in ("orders", "dim_customers", "dim_products", "dim_locations")}

_PLACE = set(LOCATION_COLUMNS) - {"location_id"}
_ORDER_LEVEL = set(ORDER_COLUMNS) | set(CUSTOMER_COLUMNS) | set(LOCATION_COLUMNS) | {KNOWN, PLACED, *HITS.values()} - {HITS["dim_products"]}


def _join(left: DataFrame, right: DataFrame, key: str, optional: bool) -> DataFrame:
    return left.join(right, key, "left" if optional else "inner")


def headers(
    star: Star,
    columns=(),
    flt: Filter = NO_FILTER,
    through=(),
    optional=(),
) -> DataFrame:
    """Order headers with customer and location columns.

    ``through`` forces a dimension join even when none of its columns is used;
    ``optional`` names dimensions whose missing rows keep the order.
    """
    asked = list(dict.fromkeys(["order_key", *columns]))
    wanted = set(asked) | flt.columns
    places = bool(wanted & _PLACE) or PLACED in wanted or "locations" in through
    needed = star.closure(wanted | ({"location_id"} if places else set()))
    customer_side = set(star.tables["dim_customers"].columns) - {"customer_id"}
    customers = bool(needed & customer_side) or KNOWN in wanted or "customers" in through
    if customers:
        needed.add("customer_id")

    frame = flt.on_dates(star.take("orders", needed))
    if customers:
        people = star.take("dim_customers", needed)
        if KNOWN in wanted:
            people = people.withColumn(KNOWN, F.lit(True))
        frame = _join(frame, people, "customer_id", "customers" in optional)
    if "location_id" in needed and "location_id" in star.derived:
        frame = frame.withColumn("location_id", star.derived["location_id"].value)
    if places:
        sites = flt.on_locations(star.take("dim_locations", needed | {"location_id"}))
        if PLACED in wanted:
            sites = sites.withColumn(PLACED, F.lit(True))
        frame = _join(frame, sites, "location_id", "locations" in optional)
    # Last, so that what is partitioned by order key stays so for the line join.
    for name, lookup in star.header_lookups.items():
        if name in needed and not star.has("orders", name):
            frame = frame.join(lookup, "order_key", "left")
    return frame.select(*asked)


def lines(
    star: Star,
    columns,
    flt: Filter = NO_FILTER,
    through=("orders",),
    optional=(),
) -> DataFrame:
    """Order lines with the given columns; an inner join per dimension used."""
    asked = list(dict.fromkeys(columns))
    needed = star.closure(set(asked) | flt.columns)
    item_side = set(star.tables["order_items"].columns)
    product_side = set(star.tables["dim_products"].columns) - {"product_id"}
    order_side = (needed & _ORDER_LEVEL) - item_side
    products = bool(needed & product_side) or STOCKED in asked or "products" in through
    orders = bool(order_side) or bool(flt.columns) or bool({"orders", "customers", "locations"} & set(through))

    keys = ({"order_key"} if orders else set()) | ({"product_id"} if products else set())
    frame = _dated(star, flt).select(*[c for c in star.tables["order_items"].columns if c in needed | keys])
    if orders:
        frame = frame.join(headers(star, sorted(order_side), flt, through, optional), "order_key")
    if products:
        goods = star.take("dim_products", needed | {"product_id"})
        if STOCKED in asked:
            goods = goods.withColumn(STOCKED, F.lit(True))
        frame = _join(frame, goods, "product_id", "products" in optional)
    present = set(frame.columns)
    for name, column in star.derived.items():
        if name in needed and name not in present and name not in _ORDER_LEVEL:
            frame = frame.withColumn(name, column.value)
    return frame.select(*asked)


def _dated(star: Star, flt: Filter) -> DataFrame:
    """Lines without those of years outside the filter's dates, where the source vouches for their year."""
    items = star.tables["order_items"]
    return flt.on_years(items) if star.dated_lines and "year" in items.columns else items


def searched(star: Star, text: str, columns: list[str]) -> tuple[Star, list[str]]:
    """The star with a flag per table whether one of its columns contains the text, and the flags' names.

    Each dimension and header is compared once, before the joins; a line only reads flags.
    """
    tables, flags = dict(star.tables), []
    for name, flag in HITS.items():
        here = [c for c in columns if c in tables[name].columns]
        if here:
            hit = reduce(lambda a, b: a | b, [F.coalesce(matches(c, text), F.lit(False)) for c in here])
            tables[name] = tables[name].withColumn(flag, hit)
            flags.append(flag)
    return replace(star, tables=tables), flags


# --- Measures -------------------------------------------------------------
# Every partial is a sum or a count of whole numbers (or of unit prices), so
# partials of any grain merge by summing. Money does not fit one 64-bit sum at
# any size of data, and decimal sums are several times slower per line: money
# is summed exactly in two 64-bit parts, the value's low 20 bits and the rest,
# which are put together only in the few rows of a result.

_LOW_BITS = 20
_MONEY_MEASURES = ("sales", "profit", "shipping_cost", "sales_listed", "profit_listed", "shipping_cost_listed")
_ONE_UNIT = "0.0001"


def _units(measure: str) -> str:
    return measure.removesuffix("_listed") + "_units"


def _cents_only(units: Column) -> Column:
    """Units rounded half-up to whole cents, as the listing shows amounts."""
    size = F.abs(units) + 50
    cents = size - size % 100
    return F.when(units < 0, -cents).otherwise(cents)


def _price() -> Column:
    return unit_price(F.col("sales_units").cast("double") / F.lit(float(UNITS_PER_ONE)))


# Measures other than money: (line columns read, partial aggregate).
_PLAIN: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "discount": (("discount_units",), lambda: F.sum("discount_units")),
    "quantity": (("quantity",), lambda: F.sum("quantity")),
    "sales_n": (("sales_units",), lambda: F.count("sales_units")),
    "discount_n": (("discount_units",), lambda: F.count("discount_units")),
    "quantity_n": (("quantity",), lambda: F.count("quantity")),
    "price": (("sales_units", "quantity"), lambda: F.sum(_price())),
    "price_n": (("sales_units", "quantity"), lambda: F.count(_price())),
    "items": (("row_id",), lambda: F.count("row_id")),
    "line_count": ((), lambda: F.count(F.lit(1))),
}


def measure_inputs(measures) -> list[str]:
    read = [c for m in measures for c in ((_units(m),) if m in _MONEY_MEASURES else _PLAIN[m][0])]
    return list(dict.fromkeys(read))


def partials(measures) -> list[Column]:
    """Aggregates of lines: one column per measure, two for money."""
    out = []
    for m in measures:
        if m not in _MONEY_MEASURES:
            out.append(_PLAIN[m][1]().alias(m))
            continue
        units = F.col(_units(m))
        units = _cents_only(units) if m.endswith("_listed") else units
        out.append(F.sum(F.shiftright(units, _LOW_BITS)).alias(f"{m}__high"))
        out.append(F.sum(units.bitwiseAND(F.lit((1 << _LOW_BITS) - 1))).alias(f"{m}__low"))
    return out


def exact_sum(whole: str, unit: str) -> Column:
    """Sum of a whole-number column times a decimal unit, in two parts like money."""
    high, low = F.sum(F.shiftright(whole, _LOW_BITS)), F.sum(F.col(whole).bitwiseAND(F.lit((1 << _LOW_BITS) - 1)))
    total = high.cast("decimal(20,0)") * F.lit(1 << _LOW_BITS).cast("decimal(7,0)") + low.cast("decimal(20,0)")
    return total * F.lit(unit).cast("decimal(8,8)")


def carried(measures) -> list[Column]:
    """Partials summed to coarser partials."""
    names = [n for m in measures for n in ((f"{m}__high", f"{m}__low") if m in _MONEY_MEASURES else (m,))]
    return [F.sum(n).alias(n) for n in names]


def _amount(measure: str, part: Callable[[str], Column]) -> Column:
    whole = "decimal(20,0)"
    if measure == "discount":
        return part(measure).cast(whole) * F.lit(_ONE_UNIT).cast("decimal(4,4)")
    if measure not in _MONEY_MEASURES:
        return part(measure)
    high, low = part(f"{measure}__high").cast(whole), part(f"{measure}__low").cast(whole)
    return (high * F.lit(1 << _LOW_BITS).cast("decimal(7,0)") + low) * F.lit(_ONE_UNIT).cast("decimal(4,4)")


def totalled(measures) -> list[Column]:
    """Partials summed to amounts: exact decimals for money and discount."""
    return [_amount(m, F.sum).alias(m) for m in measures]


def line_partials(star: Star, keys, measures, flt: Filter = NO_FILTER, through=("orders",), optional=()) -> DataFrame:
    """Partials per line-level or product-level key, straight from lines."""
    frame = lines(star, [*keys, *measure_inputs(measures)], flt, through, optional)
    return frame.groupBy(*keys).agg(*partials(measures))


def line_totals(star: Star, keys, measures, flt: Filter = NO_FILTER, through=("orders",)) -> DataFrame:
    """Amounts per line-level or product-level key."""
    frame = line_partials(star, keys, measures, flt, through)
    return frame.select(*keys, *[_amount(m, F.col).alias(m) for m in measures])


def order_totals(
    star: Star,
    measures,
    columns=(),
    flt: Filter = NO_FILTER,
    through=(),
    optional=(),
    kept: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row per order that has lines: partials plus header columns.

    A header column that the source finds in the lines (the last ship date of the trade
    tables) is one more partial of the same sum. ``kept`` picks headers by their columns
    before their lines are summed.
    """
    product_join = tuple(t for t in through if t == "products")
    found = {c: star.line_extremes[c] for c in columns if c in star.line_extremes}
    wanted = headers(star, [c for c in columns if c not in found], flt, through, optional)
    wanted = kept(wanted) if kept else wanted
    summed = replace(star, tables={**star.tables, "order_items": _dated(star, flt)})
    frame = lines(summed, ["order_key", *measure_inputs(measures), *found.values()], through=product_join)
    if flt != NO_FILTER or kept:
        # Lines of other orders go before they are summed; the sum reuses the join's partitioning.
        frame = frame.join(wanted.select("order_key"), "order_key", "left_semi")
    extremes = [F.max(source).alias(name) for name, source in found.items()]
    return frame.groupBy("order_key").agg(*partials(measures), *extremes).join(wanted, "order_key")


# --- Output measures ------------------------------------------------------

BASIC = ("sales", "profit", "quantity")
PRICED = (*BASIC, "price", "price_n")


def shown(*names: str) -> list[Column]:
    """Summed measures as they are handed out, under their own names."""
    output = {
        "sales": lambda: money("sales"),
        "profit": lambda: money("profit"),
        "quantity": lambda: F.col("quantity").cast("double"),
        "avg_unit_price": lambda: rounded(ratio("price", "price_n"), 2),
    }
    return [output[n]().alias(n) for n in names]


def ranked(frame: DataFrame, lead: str, limit: int | None = None) -> DataFrame:
    """Largest first, nulls last; every other column breaks ties."""
    rest = [F.asc(c) for c in frame.columns if c != lead]
    ordered = frame.orderBy(F.desc_nulls_last(lead), *rest)
    return ordered if limit is None else ordered.limit(limit)


def line_fact(star: Star, columns=None) -> DataFrame:
    """Order lines joined to every dimension: the widest view of the star."""
    every = columns or [
        "row_id",
        *ORDER_COLUMNS,
        "customer_name",
        "segment",
        *PRODUCT_COLUMNS,
        *[c for c in LOCATION_COLUMNS if c != "location_id"],
        "sales",
        "profit",
        "shipping_cost",
        "discount",
        "quantity",
        "year",
        "week_num",
    ]
    return lines(star, every, through=("orders", "customers", "products", "locations"))


def stored_tables(star: Star) -> dict[str, DataFrame]:
    """The five tables in full, derived columns included, ready to be written."""
    whole = {
        "order_items": lines(star, SCHEMA["order_items"]),
        "orders": headers(star, ORDER_COLUMNS),
        **{n: star.tables[n] for n in ("dim_customers", "dim_products", "dim_locations")},
    }
    return {name: conform(frame, name) for name, frame in whole.items()}
