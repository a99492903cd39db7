"""KPIs, filtered rollups, drill-downs, trends and chart series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesloom.functions.numeric import (
    bar_width,
    bubble_radius,
    fractional_days,
    margin_percent,
    money,
    net_status,
    percent,
    ratio,
    rounded,
)
from salesloom.functions.text import (
    PRIORITY_LEVELS,
    SEGMENT_LEVELS,
    SHIP_MODE_LEVELS,
    compact_money,
    count_text,
    level_of,
    percent_text,
    profit_level,
)
from salesloom.plans.fact import (
    BASIC,
    PRICED,
    carried,
    exact_sum,
    headers,
    line_partials,
    line_totals,
    lines,
    order_totals,
    ranked,
    shown,
    totalled,
)
from salesloom.plans.filters import NO_FILTER, Filter
from salesloom.sources.star import UNITS_PER_ONE, Star

TOP_SUBCATEGORIES = 10
QUANTITY_SUBCATEGORIES = 12
DRILL_ROWS = 8
DEAREST = 8
WEEKS_SHOWN = 200

# Fixed value: the error of a drill-down without a region.
REGION_REQUIRED = "region param required"


# --- Global KPIs ----------------------------------------------------------

KPI_PARTIALS = ("sales", "profit", "shipping_cost", "discount", "discount_n", "quantity", "quantity_n", "items")


def kpi(star: Star, flt: Filter = NO_FILTER) -> DataFrame:
    """Eleven KPIs over two grains: order counts and line sums."""
    return kpi_rows(order_totals(star, KPI_PARTIALS, ["order_id_raw", "customer_id"], flt))


def kpi_rows(per_order: DataFrame) -> DataFrame:
    total = per_order.agg(
        *totalled(KPI_PARTIALS),
        F.count(F.lit(1)).alias("order_keys"),
        F.count_distinct("order_id_raw").alias("total_orders"),
        F.count_distinct("customer_id").alias("total_customers"),
    )
    return total.select(
        money("sales").alias("total_revenue"),
        money("profit").alias("total_profit"),
        "total_orders",
        "total_customers",
        percent("discount", "discount_n", 1).alias("avg_discount_pct"),
        money("shipping_cost").alias("total_shipping_cost"),
        F.coalesce("items", F.lit(0)).alias("total_items"),
        rounded(ratio("quantity", "quantity_n"), 1).alias("avg_quantity"),
        F.col("quantity").cast("double").alias("total_quantity"),
        rounded(ratio("sales", "order_keys"), 2).alias("avg_order_value"),
        rounded(ratio("items", "order_keys"), 1).alias("avg_items_per_order"),
    )


def kpi_formatted(kpis: DataFrame) -> DataFrame:
    """The KPI row as display text."""
    return kpis.select(
        compact_money("total_revenue").alias("revenue_text"),
        compact_money("total_profit").alias("profit_text"),
        compact_money("total_shipping_cost").alias("shipping_text"),
        compact_money("avg_order_value").alias("order_value_text"),
        count_text("total_orders").alias("orders_text"),
        count_text("total_items").alias("items_text"),
        percent_text("avg_discount_pct").alias("discount_text"),
    )


# --- Line-level keys: year, week, product attributes ----------------------


def _by_product(star: Star, keys, flt: Filter) -> DataFrame:
    return line_totals(star, keys, PRICED, flt)


def revenue_by_year(star: Star, flt: Filter = NO_FILTER) -> DataFrame:
    return year_rows(line_totals(star, ["year"], BASIC, flt))


def year_rows(totals: DataFrame) -> DataFrame:
    revenue = money("sales").alias("revenue")
    return totals.select("year", revenue, *shown("profit", "quantity")).orderBy("year")


def sales_by_category(star: Star, flt: Filter = NO_FILTER) -> DataFrame:
    return category_rows(_by_product(star, ["category"], flt))


def category_rows(totals: DataFrame) -> DataFrame:
    return ranked(totals.select("category", *shown(*BASIC, "avg_unit_price")), "sales")


def top_subcategory(star: Star, flt: Filter = NO_FILTER, limit: int = TOP_SUBCATEGORIES) -> DataFrame:
    return subcategory_rows(_by_product(star, ["sub_category"], flt), limit)


def subcategory_rows(totals: DataFrame, limit: int = TOP_SUBCATEGORIES) -> DataFrame:
    return ranked(totals.select("sub_category", *shown(*BASIC, "avg_unit_price")), "sales", limit)


def quantity_stats(star: Star, flt: Filter = NO_FILTER, limit: int = QUANTITY_SUBCATEGORIES) -> DataFrame:
    return quantity_rows(_by_product(star, ["sub_category"], flt), limit)


def quantity_rows(totals: DataFrame, limit: int = QUANTITY_SUBCATEGORIES) -> DataFrame:
    revenue = money("sales").alias("revenue")
    rows = totals.select("sub_category", revenue, *shown("quantity", "avg_unit_price", "profit"))
    return ranked(rows, "revenue", limit)


def weekly_trend(star: Star, limit: int = WEEKS_SHOWN) -> DataFrame:
    """First weeks of the series; year and week are taken as stored."""
    totals = line_totals(star, ["year", "week_num"], ("sales", "profit"), through=())
    return totals.select("year", "week_num", *shown("sales", "profit")).orderBy("year", "week_num").limit(limit)


def profit_margin_trend(star: Star) -> DataFrame:
    totals = line_totals(star, ["year"], ("sales", "profit"), through=())
    margin = percent("profit", "sales", 2).alias("margin_pct")
    return totals.select("year", *shown("sales", "profit"), margin).orderBy("year")


def monthly_sales_trend(star: Star, flt: Filter = NO_FILTER) -> DataFrame:
    """Sales and profit per calendar month of the order date."""
    measures = ("sales", "profit", "line_count")
    per_order = order_totals(star, measures, ["order_date"], flt)
    by_month = per_order.groupBy(F.date_format("order_date", "yyyy-MM").alias("month")).agg(*totalled(measures))
    return by_month.select("month", *shown("sales", "profit"), "line_count").orderBy("month")


def profit_histogram(star: Star, width: float = 5000.0) -> DataFrame:
    """Lines per profit bucket of equal width."""
    bucket = F.floor(F.col("profit").cast("double") / F.lit(width)) * F.lit(width)
    counted = lines(star, ["profit"], through=()).groupBy(bucket.cast("double").alias("bucket_start"))
    return counted.agg(F.count(F.lit(1)).alias("line_count")).orderBy("bucket_start")


def profit_vs_discount(star: Star) -> DataFrame:
    """Per discount level: lines, average profit and share of losing lines."""
    level = lines(star, ["discount_units", "profit_units"], through=()).groupBy("discount_units")
    losing = F.sum(F.when(F.col("profit_units") < 0, 1).otherwise(0))
    totals = level.agg(
        F.count(F.lit(1)).alias("line_count"),
        exact_sum("profit_units", "0.0001").alias("profit"),
        F.count("profit_units").alias("profit_n"),
        losing.alias("losing"),
    )
    return totals.select(
        (F.col("discount_units").cast("double") / F.lit(float(UNITS_PER_ONE))).alias("discount"),
        "line_count",
        rounded(ratio("profit", "profit_n"), 2).alias("avg_profit"),
        percent("losing", "line_count", 1).alias("loss_share_pct"),
    ).orderBy("discount")


# --- Order-level keys: place, segment, ship mode, priority ----------------


def profit_by_market(star: Star, flt: Filter = NO_FILTER) -> DataFrame:
    per_order = order_totals(star, BASIC, ["market"], flt)
    return market_rows(per_order.groupBy("market").agg(*totalled(BASIC)))


def market_rows(totals: DataFrame) -> DataFrame:
    return ranked(totals.select("market", *shown(*BASIC)), "profit")


def region_stats(star: Star, flt: Filter = NO_FILTER) -> DataFrame:
    per_order = order_totals(star, PRICED, ["region"], flt)
    return region_rows(per_order.groupBy("region").agg(*totalled(PRICED), F.count(F.lit(1)).alias("orders")))


def region_rows(totals: DataFrame) -> DataFrame:
    return ranked(totals.select("region", *shown("sales", "profit"), "orders", *shown("quantity", "avg_unit_price")), "sales")


def segment_stats(star: Star, flt: Filter = NO_FILTER) -> DataFrame:
    """Per segment: customers, orders and sums.

    Orders are summed per customer before the customer join, so a customer with
    very many orders is one row there, and customers need no distinct count.
    """
    per_customer = _per_customer(order_totals(star, BASIC, ["customer_id"], flt))
    return segment_rows(per_customer.join(star.take("dim_customers", ("customer_id", "segment")), "customer_id"))


def segment_rows_of(per_order: DataFrame) -> DataFrame:
    """The same of orders that bring their segment along."""
    return segment_rows(_per_customer(per_order, "segment"))


def _per_customer(per_order: DataFrame, *keys: str) -> DataFrame:
    return per_order.groupBy("customer_id", *keys).agg(*carried(BASIC), F.count(F.lit(1)).alias("orders"))


def segment_rows(per_customer: DataFrame) -> DataFrame:
    totals = per_customer.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("orders").alias("orders"), *totalled(BASIC)
    )
    return ranked(totals.select("segment", "customers", "orders", *shown(*BASIC)), "sales")


def _lead_time(per_order: DataFrame, key: str) -> DataFrame:
    """Orders, sales and line-weighted days to ship per header attribute."""
    days = fractional_days("order_date", "ship_date")
    return (
        per_order.withColumn("days", days)
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("order_count"),
            *totalled(["sales"]),
            F.sum(F.col("days") * F.col("line_count")).alias("line_days"),
            F.sum(F.when(F.col("days").isNotNull(), F.col("line_count"))).alias("dated_lines"),
        )
    )


def _dated_orders(star: Star, key: str) -> DataFrame:
    return order_totals(star, ("sales", "line_count"), [key, "order_date", "ship_date"])


def orders_by_shipmode(star: Star) -> DataFrame:
    return shipmode_rows(_dated_orders(star, "ship_mode"))


def shipmode_rows(per_order: DataFrame) -> DataFrame:
    totals = _lead_time(per_order, "ship_mode").select(
        "ship_mode",
        "order_count",
        money("sales").alias("total_sales"),
        rounded(ratio("sales", "order_count"), 2).alias("avg_order_value"),
        rounded(ratio("line_days", "dated_lines"), 1).alias("avg_shipping_days"),
    )
    return ranked(totals, "order_count")


def orders_by_priority(star: Star) -> DataFrame:
    totals = _lead_time(_dated_orders(star, "order_priority"), "order_priority").select(
        "order_priority",
        "order_count",
        money("sales").alias("total_sales"),
        rounded(ratio("line_days", "dated_lines"), 1).alias("avg_shipping_days"),
    )
    return ranked(totals, "order_count")


# --- Region drill-down ----------------------------------------------------


def required_region(region: str | None) -> Filter:
    flt = Filter(region=region)
    if flt.region is None:
        raise ValueError(REGION_REQUIRED)
    return flt


def drill_subcategories(star: Star, region: str, limit: int = DRILL_ROWS) -> DataFrame:
    """Top sub-categories of a region, each with one (its first) category."""
    flt = required_region(region)
    return drill_subcategory_rows(line_partials(star, ["sub_category", "category"], PRICED, flt), limit)


def drill_subcategory_rows(partial_sums: DataFrame, limit: int = DRILL_ROWS) -> DataFrame:
    totals = partial_sums.groupBy("sub_category").agg(F.min("category").alias("category"), *totalled(PRICED))
    return ranked(totals.select("sub_category", "category", *shown(*BASIC, "avg_unit_price")), "sales", limit)


def drill_segments(star: Star, region: str) -> DataFrame:
    return drill_segment_rows(segment_stats(star, required_region(region)))


def drill_segment_rows(stats: DataFrame) -> DataFrame:
    return ranked(stats.select("segment", "sales", "profit", "quantity", "orders"), "sales")


def drill_trend(star: Star, region: str) -> DataFrame:
    totals = line_totals(star, ["year"], BASIC, required_region(region))
    return drill_trend_rows(totals)


def drill_trend_rows(totals: DataFrame) -> DataFrame:
    return totals.select("year", *shown(*BASIC)).orderBy("year")


def drill_countries(star: Star, region: str, limit: int = DRILL_ROWS) -> DataFrame:
    per_order = order_totals(star, BASIC, ["country"], required_region(region))
    return drill_country_rows(per_order.groupBy("country").agg(*totalled(BASIC)), limit)


def drill_country_rows(totals: DataFrame, limit: int = DRILL_ROWS) -> DataFrame:
    return ranked(totals.select("country", *shown(*BASIC)), "sales", limit)


def segment_share(segments: DataFrame) -> DataFrame:
    """Each segment's share of the sales; a window over one row per segment."""
    whole = F.sum("sales").over(Window.partitionBy())
    share = F.when(whole > 0, rounded(F.col("sales") / whole * F.lit(100.0), 1)).otherwise(F.lit(0.0))
    return segments.select("segment", "sales", "quantity", share.alias("share_pct"))


# --- Chart series on finished rollups -------------------------------------


def by_metric(rows: DataFrame, label: str, metric: str) -> DataFrame:
    """One measure of a ranked rollup; the rows stay ranked by sales."""
    if metric not in ("sales", "quantity"):
        raise ValueError(f"metric must be sales or quantity, not {metric!r}")
    return rows.select(label, F.col(metric).alias("value"))


def avg_price_top(stats: DataFrame, limit: int = DEAREST) -> DataFrame:
    """The dearest sub-categories among those the quantity chart shows."""
    return ranked(stats.select("sub_category", "avg_unit_price"), "avg_unit_price", limit)


def quantity_bubble(stats: DataFrame) -> DataFrame:
    return stats.select(
        "sub_category",
        F.col("quantity").alias("x"),
        F.col("revenue").alias("y"),
        rounded(bubble_radius("avg_unit_price"), 4).alias("radius"),
        "profit",
    )


def profit_badge_counts(star: Star) -> DataFrame:
    """Lines per profit badge level."""
    counted = lines(star, ["profit"], through=()).groupBy(profit_level(F.round("profit", 2)).alias("level"))
    return counted.agg(F.count(F.lit(1)).alias("line_count"), money(F.sum("profit")).alias("profit"))


def net_status_counts(star: Star) -> DataFrame:
    counted = lines(star, ["profit"], through=()).groupBy(net_status("profit").alias("net_status"))
    return counted.agg(F.count(F.lit(1)).alias("line_count"))


def badge_level_counts(star: Star) -> DataFrame:
    """Orders per badge level of segment, priority and ship mode."""
    tags = headers_with_badges(star)
    level = F.explode(
        F.array(
            *[
                F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("value"), level_of(kind, levels).alias("level"))
                for kind, levels in (
                    ("segment", SEGMENT_LEVELS),
                    ("order_priority", PRIORITY_LEVELS),
                    ("ship_mode", SHIP_MODE_LEVELS),
                )
            ]
        )
    ).alias("badge")
    return (
        tags.select("orders", level)
        .groupBy("badge.kind", "badge.value", "badge.level")
        .agg(F.sum("orders").alias("order_count"))
    )


def headers_with_badges(star: Star) -> DataFrame:
    keys = ["segment", "order_priority", "ship_mode"]
    return headers(star, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("orders"))


def margin_metrics(star: Star) -> DataFrame:
    """Margin, bar width and discount cost per line, summed up per sub-category.

    Sales times discount is a whole number of 10^-8 and is summed exactly.
    """
    per_line = lines(star, ["sub_category", "sales", "profit", "sales_units", "discount_units"], through=())
    margin = margin_percent("profit", "sales")
    impact = F.col("sales_units") * F.col("discount_units")
    return (
        per_line.select("sub_category", margin.alias("margin"), impact.alias("impact"))
        .groupBy("sub_category")
        .agg(
            F.count(F.lit(1)).alias("line_count"),
            F.round(F.min("margin"), 4).alias("min_margin_pct"),
            F.round(F.max("margin"), 4).alias("max_margin_pct"),
            rounded(F.avg(bar_width("margin")), 4).alias("avg_bar_width"),
            rounded(exact_sum("impact", "0.00000001"), 4).alias("discount_impact"),
        )
    )
