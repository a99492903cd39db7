"""Country catalog, hierarchies, and the country performance panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesloom.functions.numeric import ratio_or_zero
from salesloom.functions.text import day_text
from salesloom.plans.fact import headers, lines, order_totals, totalled
from salesloom.plans.filters import NO_FILTER, Filter, in_window, on_day, step_day_column
from salesloom.sources.star import Star

# The modes the panel lists, in its order.
SHIP_MODES = ("Standard Class", "Second Class", "First Class", "Same Day")
DEFAULT_MODE = "Standard Class"

_EVERY_TABLE = ("orders", "customers", "products", "locations")
_LISTED = ("sales_listed", "profit_listed", "shipping_cost_listed", "quantity", "line_count")


def country_catalog(star: Star) -> DataFrame:
    """Per country with orders: region, market, distinct orders and cities."""
    placed = headers(star, ["order_id_raw", "city", "country", "region", "market"])
    return placed.groupBy("country").agg(
        F.min("region").alias("region"),
        F.min("market").alias("market"),
        F.count_distinct("order_id_raw").alias("orders"),
        F.count_distinct("city").alias("cities"),
    )


def market_countries(star: Star) -> DataFrame:
    """Sorted countries of each market; one without a market is ``Other``.

    The lists hold entries of a taxonomy, taken from the dimension table after
    duplicates are gone: they do not grow with the orders.
    """
    market = F.coalesce(F.nullif(F.col("market"), F.lit("")), F.lit("Other")).alias("market")
    places = star.tables["dim_locations"].groupBy("country").agg(F.min("market").alias("market"))
    return places.groupBy(market).agg(F.sort_array(F.collect_list("country")).alias("countries"))


def category_hierarchy(star: Star) -> DataFrame:
    """Sorted sub-categories of each category."""
    pairs = star.tables["dim_products"].select("category", "sub_category").distinct()
    return pairs.groupBy("category").agg(F.sort_array(F.collect_list("sub_category")).alias("sub_categories"))


def listed_out(frame: DataFrame, key: str, values: str, value: str) -> DataFrame:
    """One row per list entry, with its position."""
    return frame.select(key, F.posexplode(values).alias("position", value))


def country_highlight(star: Star, flt: Filter = NO_FILTER) -> DataFrame:
    """Map state per catalog country under the region and market filter."""
    matched = F.lit(True)
    for name in ("region", "market"):
        if getattr(flt, name):
            matched = matched & F.coalesce(F.col(name) == F.lit(getattr(flt, name)), F.lit(False))
    state = F.when(matched, "matched").otherwise("dimmed") if flt.region or flt.market else F.lit("neutral")
    places = headers(star, ["country", "region", "market"]).groupBy("country")
    catalog = places.agg(F.min("region").alias("region"), F.min("market").alias("market"))
    return catalog.select("country", "region", "market", state.alias("state"))


def country_lines(star: Star, country: str) -> DataFrame:
    """Every line of one country with amounts as listed (cents)."""
    amounts = ("sales", "profit", "shipping_cost")
    kept = ["order_id_raw", "order_date", "ship_mode", *amounts, "quantity"]
    frame = lines(star, [*kept, "country"], through=_EVERY_TABLE).where(F.col("country") == F.lit(country))
    shaped = {c: F.round(c, 2).cast("double").alias(c) for c in amounts}
    shaped["order_date"] = day_text("order_date").alias("order_date")
    return frame.select(*[shaped.get(c, F.col(c)) for c in kept])


def _country_orders(star: Star, country: str, window=None, day=None, columns=()) -> DataFrame:
    """One row per order of the country in the window, with its line sums; lines of other orders go first."""

    def kept(found: DataFrame) -> DataFrame:
        found = found.where(F.col("country") == F.lit(country))
        if day is not None:
            return on_day(found, day)
        return found if window is None else in_window(found, *window)

    frame = order_totals(star, _LISTED, ["country", "order_date", "order_id_raw", *columns], through=_EVERY_TABLE, kept=kept)
    # A header without a business id counts as an order of its own.
    raw = F.coalesce(F.nullif(F.col("order_id_raw"), F.lit("")), F.col("order_key").cast("string"))
    return frame.withColumn("order_id_raw", raw)


def country_stats(star: Star, country: str, window=None, day=None) -> DataFrame:
    """One row of panel metrics; all zero when nothing matches."""
    orders = _country_orders(star, country, window, day)
    total = orders.agg(*totalled(_LISTED), F.count_distinct("order_id_raw").alias("orders"))
    sums = total.select(
        *[
            F.coalesce(F.col(f"{c}_listed").cast("double"), F.lit(0.0)).alias(c)
            for c in ("sales", "profit", "shipping_cost")
        ],
        F.coalesce("quantity", F.lit(0)).alias("units"),
        F.coalesce("line_count", F.lit(0)).alias("line_items"),
        "orders",
    )
    return sums.select(
        "*",
        ratio_or_zero("profit", "sales", 100.0).alias("margin_pct"),
        ratio_or_zero("shipping_cost", "orders").alias("shipping_per_order"),
        ratio_or_zero("shipping_cost", "sales", 100.0).alias("shipping_sales_pct"),
    )


def country_shipmode(star: Star, country: str, window=None, day=None) -> DataFrame:
    """The four ship modes with orders, sales, shipping and share of orders.

    An order belongs to the mode of its newest header; a blank mode is the
    default one; other modes are left out but stay in the share's base.
    """
    orders = _country_orders(star, country, window, day, ["ship_mode"])
    blank = F.col("ship_mode").isNull() | (F.col("ship_mode") == "")
    orders = orders.withColumn("ship_mode", F.when(blank, DEFAULT_MODE).otherwise(F.col("ship_mode")))

    newest = F.max(F.struct("order_date", "ship_mode"))["ship_mode"]
    by_raw_id = orders.groupBy("order_id_raw").agg(newest.alias("ship_mode"))

    def per_mode(frame: DataFrame, *measures) -> DataFrame:
        mode = F.when(F.col("ship_mode").isin(*SHIP_MODES), F.col("ship_mode")).alias("ship_mode")
        return frame.groupBy(mode).agg(*measures)

    amounts = ("sales_listed", "shipping_cost_listed")
    # Five rows at most: the listed modes, and all others together.
    listed = orders.sparkSession.range(1).select(F.explode(F.array(*[F.lit(m) for m in SHIP_MODES])).alias("ship_mode"))
    rows = (
        listed.unionByName(per_mode(by_raw_id, F.count(F.lit(1)).alias("orders")), allowMissingColumns=True)
        .unionByName(per_mode(orders, *totalled(amounts)), allowMissingColumns=True)
        .groupBy("ship_mode")
        .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("orders", *amounts)])
        .withColumn("all_orders", F.sum("orders").over(Window.partitionBy()))
    )
    return rows.where("ship_mode IS NOT NULL").select(
        "ship_mode",
        "orders",
        F.col("sales_listed").cast("double").alias("sales"),
        F.col("shipping_cost_listed").cast("double").alias("shipping"),
        ratio_or_zero("orders", "all_orders", 100.0).alias("order_share_pct"),
    )


def stepped_days(star: Star, delta: int, low, high) -> DataFrame:
    """Every order day with the days ``delta`` before and after, clamped."""
    days = headers(star, ["order_date"]).select(F.to_date("order_date").alias("day")).distinct()
    return days.select(
        day_text("day").alias("day"),
        day_text(step_day_column("day", -delta, low, high)).alias("previous_day"),
        day_text(step_day_column("day", delta, low, high)).alias("next_day"),
    )
