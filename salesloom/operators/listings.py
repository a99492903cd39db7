"""Searchable listings, per-entity rollups, totals and paging."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesloom.functions.numeric import money, percent, ratio, rounded
from salesloom.functions.text import day_text, search
from salesloom.plans.fact import headers, line_partials, line_totals, lines, order_totals, searched, totalled
from salesloom.plans.filters import NO_FILTER, Filter
from salesloom.sources.star import CUSTOMER_COLUMNS, LOCATION_COLUMNS, PRODUCT_COLUMNS, Star

DEFAULT_PAGE, DEFAULT_LIMIT = 1, 20

SEARCHED = {
    "orders": ["order_id_raw", "customer_name", "category", "sub_category", "country", "ship_mode"],
    "products": ["product_name", "category", "sub_category"],
    "customers": ["customer_name", "segment"],
    "locations": ["city", "country", "region", "market"],
}

# Rows before a page that its last step, a top-k, may hold.
SPAN = 20_000
CUTS = 64  # ranges that a round of the rank selection splits a column into, about
TEXT_BYTES = 6  # of a text that one round looks at: they make a whole number


# --- Paging ---------------------------------------------------------------


def page_request(page=None, limit=None) -> tuple[int, int]:
    """Page and limit as integers; one that is no integer resets both."""
    try:
        return (
            int(DEFAULT_PAGE if page is None else page),
            int(DEFAULT_LIMIT if limit is None else limit),
        )
    except (TypeError, ValueError):
        return DEFAULT_PAGE, DEFAULT_LIMIT


def listing_order(frame: DataFrame, lead: str) -> list[Column]:
    """Largest first, nulls last, ties broken by every other column."""
    return [F.desc_nulls_last(lead), *[F.asc_nulls_first(c) for c in frame.columns if c != lead]]


def page_of(frame: DataFrame, lead: str, page=None, limit=None, span: int = SPAN) -> DataFrame:
    """One page of a listing ranked by ``lead``."""
    number, size = page_request(page, limit)
    if size < 0:  # a negative limit means all rows
        return frame.orderBy(*listing_order(frame, lead))
    return rows_at(frame, lead, max((number - 1) * size, 0), size, span)


def rows_at(frame: DataFrame, lead: str, offset: int, size: int, span: int = SPAN) -> DataFrame:
    """Rows ``offset .. offset + size`` of the ranked listing, by selection of their ranks.

    The listing is narrowed to the range of its leading column that holds the
    page, then to that of the next column among equal ones, while more than ``span``
    rows lie before the page in the range. A round reads one column: its
    approximate quantiles, then the number of rows at and between them. What is
    left is a top-k of at most ``span + size`` rows; nothing is sorted or written whole.
    """
    order = listing_order(frame, lead)
    ranking = [lead, *[c for c in frame.columns if c != lead]]
    parts = _narrowed(frame, ranking, lead, offset, size, span)
    pages = [(part.orderBy(*order).offset(skip) if skip else part.orderBy(*order)).limit(count) for part, skip, count in parts]
    return pages[0] if len(pages) == 1 else reduce(DataFrame.unionByName, pages).orderBy(*order)


def _narrowed(frame: DataFrame, ranking: list[str], lead: str, offset: int, size: int, span: int) -> list[tuple[DataFrame, int, int]]:
    """Ranges of the listing that make up the page together: (rows, rows before the page, rows of it)."""
    parts: list[tuple[DataFrame, int, int]] = []
    for name in ranking:
        step = 0
        while offset > span:
            key, more = _sort_key(frame, name, step)
            ranges = _ranges(frame, key, descending=name == lead)
            first, before = 0, 0
            while first < len(ranges) and before + ranges[first].rows <= offset:
                before += ranges[first].rows
                first += 1
            if first == len(ranges):  # the page lies behind the last row
                return [(frame.limit(0), 0, size)]
            here, behind = ranges[first], ranges[first + 1 :]
            in_range = min(size, before + here.rows - offset)
            if in_range < size and behind:
                rest = reduce(lambda x, y: x | y, [r.holds for r in behind])
                parts.append((frame.where(rest), 0, size - in_range))
            frame, offset, size = frame.where(here.holds), offset - before, in_range
            if here.single:
                if here.null or not more:
                    break
                step += 1
        if offset <= span:
            break
    # Rows equal in every column are as good as each other.
    return [(frame, offset if offset <= span else 0, size), *reversed(parts)]


@dataclass(frozen=True)
class _Range:
    """A part of a sort key: rows in it, whether they all have one value, and the condition."""

    rows: int
    single: bool
    null: bool
    holds: Column


def _sort_key(frame: DataFrame, name: str, step: int) -> tuple[Column, bool]:
    """What a column sorts by, as something with quantiles, and whether it goes on; texts a few bytes a step."""
    kind = frame.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return F.col(name).cast("int"), False
    if not isinstance(kind, T.StringType):
        return F.col(name), False
    longest = frame.agg(F.max(F.octet_length(name))).first()[0] or 0
    data = F.substring(F.encode(F.col(name), "UTF-8"), step * TEXT_BYTES + 1, TEXT_BYTES)
    number = F.conv(F.rpad(F.hex(data), 2 * TEXT_BYTES, "0"), 16, 10).cast("bigint")
    return number, (step + 1) * TEXT_BYTES < longest


def _ranges(frame: DataFrame, key: Column, descending: bool) -> list[_Range]:
    """The rows at and between the quantiles of a key, in the order of the listing."""
    keys = frame.select(key.alias("k"))
    shares = [k / CUTS for k in range(CUTS + 1)]
    cuts = sorted(set(keys.agg(F.percentile_approx("k", shares, 10 * CUTS).alias("cuts")).first()["cuts"] or []))
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else None
    if bounds is None:
        place = F.lit(None).cast("int")
    else:  # even: between two cuts; odd: at one
        place = F.when(F.col("k").isNotNull(), 2 * F.size(F.filter(bounds, lambda c: c < F.col("k"))) + F.array_contains(bounds, F.col("k")).cast("int"))
    counts = {r["place"]: r["n"] for r in keys.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).collect()}
    out = [_Range(n, place % 2 == 1, False, _holds(key, cuts, place)) for place, n in sorted((p, n) for p, n in counts.items() if p is not None)]
    if descending:
        out.reverse()
    if None in counts:  # last in the leading column, first in the others
        out.insert(len(out) if descending else 0, _Range(counts[None], True, True, key.isNull()))
    return out


def _holds(key: Column, cuts: list, place: int) -> Column:
    at = place // 2
    if place % 2:
        return key == F.lit(cuts[at])
    low = key > F.lit(cuts[at - 1]) if at else F.lit(True)
    return low & (key < F.lit(cuts[at])) if at < len(cuts) else low


def page_after(frame: DataFrame, lead: str, last: dict | None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Next page after the row ``last``: keyset paging, each page one top-k.

    ``last`` holds the full last row shown, null values included.
    """
    order = listing_order(frame, lead)
    if last is None:
        return frame.orderBy(*order).limit(limit)
    ranking = [lead, *[c for c in frame.columns if c != lead]]
    later, equal_so_far = F.lit(False), F.lit(True)
    for name in ranking:
        column, value = F.col(name), last[name]
        if value is None:
            # Lead: nulls come last. Others: nulls come first.
            beyond = F.lit(False) if name == lead else column.isNotNull()
        elif name == lead:
            beyond = (column < F.lit(value)) | column.isNull()
        else:
            beyond = column > F.lit(value)
        later = later | (equal_so_far & F.coalesce(beyond, F.lit(False)))
        equal_so_far = equal_so_far & column.eqNullSafe(F.lit(value))
    return frame.where(later).orderBy(*order).limit(limit)


def page_info(totals: DataFrame, page=None, limit=None) -> DataFrame:
    """Page count, offset and shown row range for each listing total."""
    number, size = page_request(page, limit)
    return totals.select(
        "listing",
        "total",
        F.lit(number).alias("page"),
        F.lit(size).alias("page_size"),
        F.ceil(F.try_divide(F.col("total").cast("double"), F.lit(float(size)))).cast("bigint").alias("page_count"),
        F.lit((number - 1) * size).cast("bigint").alias("row_offset"),
        F.lit((number - 1) * size + 1).cast("bigint").alias("first_row"),
        F.least(F.lit(number * size).cast("bigint"), F.col("total")).alias("last_row"),
    )


def page_count(total: int, limit: int) -> int:
    return math.ceil(total / limit)


# --- Order lines ----------------------------------------------------------

_EVERY_TABLE = ("orders", "customers", "products", "locations")


def _listing_lines(star: Star, text: str | None, flt: Filter, extra=()) -> DataFrame:
    wanted, flags = (text or "").strip(), []
    if wanted:
        star, flags = searched(star, wanted, SEARCHED["orders"])
    frame = lines(star, [*extra, *flags], flt, through=_EVERY_TABLE)
    return frame.where(reduce(lambda a, b: a | b, [F.col(f) for f in flags])).drop(*flags) if flags else frame


# Listed columns in order, amounts as the whole numbers they are stored as.
_LISTED = (
    "order_id_raw", "customer_name", "segment", "category", "sub_category", "product_name",
    "sales_units", "profit_units", "discount_units", "quantity", "shipping_cost_units", "ship_mode",
    "order_priority", "order_date", "ship_date", "city", "country", "market", "region",
)


def _shown_lines(frame: DataFrame) -> DataFrame:
    """Money to cents, discount in percent, dates as ISO days."""

    def amount(name: str) -> Column:
        return F.col(f"{name}_units").cast("decimal(18,0)") * F.lit("0.0001").cast("decimal(4,4)")

    shaped = {
        **{f"{name}_units": money(amount(name)).alias(name) for name in ("sales", "profit", "shipping_cost")},
        "discount_units": F.round(amount("discount") * 100, 1).cast("double").alias("discount_pct"),
        **{name: day_text(name).alias(name) for name in ("order_date", "ship_date")},
    }
    return frame.select(*[shaped.get(c, F.col(c)) for c in _LISTED])


def orders_listing(star: Star, text: str | None = None, flt: Filter = NO_FILTER) -> DataFrame:
    """Order lines as listed: 19 columns."""
    return _shown_lines(_listing_lines(star, text, flt, _LISTED))


def orders_page(star: Star, text=None, page=None, limit=None, flt: Filter = NO_FILTER, span: int = SPAN) -> DataFrame:
    """Newest lines first; only the rows of the page are formatted."""
    return _shown_lines(page_of(_listing_lines(star, text, flt, _LISTED), "order_date", page, limit, span))


# --- Products, customers, locations ---------------------------------------


def products_rollup(star: Star, text: str | None = None) -> DataFrame:
    """Every product, sold or not; lines are summed before they meet it."""
    sold = line_totals(star, ["product_id"], ("sales", "sales_n", "profit", "items"), through=())
    goods = search(star.take("dim_products", PRODUCT_COLUMNS), text, SEARCHED["products"])
    joined = goods.join(sold, "product_id", "left")
    return joined.select(
        "product_id",
        "category",
        "sub_category",
        "product_name",
        rounded(ratio("sales", "sales_n"), 2).alias("avg_sales"),
        money("profit").alias("total_profit"),
        F.coalesce("items", F.lit(0)).alias("times_sold"),
    )


def _orders_with_sums(star: Star, key: str, measures) -> DataFrame:
    """Per header key: orders, with or without lines, and the sums of lines."""
    per_order = line_partials(star, ["order_key"], measures, through=())
    kept = headers(star, [key]).join(per_order, "order_key", "left")
    return kept.groupBy(key).agg(F.count("order_key").alias("total_orders"), *totalled(measures))


def customers_rollup(star: Star, text: str | None = None) -> DataFrame:
    """Every customer, with or without orders."""
    totals = _orders_with_sums(star, "customer_id", ("sales", "profit", "discount", "discount_n"))
    people = search(star.take("dim_customers", CUSTOMER_COLUMNS), text, SEARCHED["customers"])
    joined = people.join(totals, "customer_id", "left")
    return joined.select(
        "customer_id",
        "customer_name",
        "segment",
        F.coalesce("total_orders", F.lit(0)).alias("total_orders"),
        money("sales").alias("total_sales"),
        money("profit").alias("total_profit"),
        percent("discount", "discount_n", 1).alias("avg_discount"),
    )


def locations_rollup(star: Star, text: str | None = None) -> DataFrame:
    """Every location, with or without orders."""
    totals = _orders_with_sums(star, "location_id", ("sales", "profit"))
    sites = search(star.tables["dim_locations"], text, SEARCHED["locations"])
    joined = sites.join(totals, "location_id", "left")
    return joined.select(
        *LOCATION_COLUMNS,
        F.coalesce("total_orders", F.lit(0)).alias("total_orders"),
        money("sales").alias("total_sales"),
        money("profit").alias("total_profit"),
    )


def products_page(star: Star, text=None, page=None, limit=None) -> DataFrame:
    return page_of(products_rollup(star, text), "total_profit", page, limit)


def customers_page(star: Star, text=None, page=None, limit=None) -> DataFrame:
    return page_of(customers_rollup(star, text), "total_sales", page, limit)


def locations_page(star: Star, text=None, page=None, limit=None) -> DataFrame:
    return page_of(locations_rollup(star, text), "total_sales", page, limit)


# --- Totals ---------------------------------------------------------------


def pagination_counts(star: Star, text: str | None = None) -> DataFrame:
    """Matching rows of each listing; customers count distinct ids."""

    def counted(name: str, frame: DataFrame, what: Column) -> DataFrame:
        return frame.agg(what.alias("total")).select(F.lit(name).alias("listing"), "total")

    every = F.count(F.lit(1))
    parts = [counted("orders", _order_line_count(star, text), F.coalesce(F.sum("n"), F.lit(0)))]
    for name, table, what in (
        ("products", "dim_products", every),
        ("customers", "dim_customers", F.count_distinct("customer_id")),
        ("locations", "dim_locations", every),
    ):
        parts.append(counted(name, search(star.tables[table], text, SEARCHED[name]), what))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _order_line_count(star: Star, text: str | None) -> DataFrame:
    if (text or "").strip():
        return _listing_lines(star, text, NO_FILTER).select(F.lit(1).cast("bigint").alias("n"))
    per_order = order_totals(star, ("line_count",), (), through=_EVERY_TABLE)
    return per_order.select(F.col("line_count").alias("n"))
