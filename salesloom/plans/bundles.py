"""Result sets that are asked for together and share their passes.

A bundle reads the lines twice, whatever it holds: once summed by product attributes
(their number does not grow with the data), once summed by order with all
measures and header columns of its order-grain members. Both frames are written
to the shared folder and the members are read from there. Nothing stays cached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.operators import rollups
from salesloom.plans.fact import BASIC, KNOWN, PLACED, PRICED, STOCKED, carried, line_partials, order_totals, totalled
from salesloom.plans.filters import NO_FILTER, Filter
from salesloom.session import stored
from salesloom.sources.star import Star


def _goods(star: Star, flt: Filter) -> DataFrame:
    keys = ["year", "category", "sub_category", STOCKED]
    return stored(line_partials(star, keys, PRICED, flt, optional=("products",)), "goods")


def dashboard_summary(star: Star, flt: Filter = NO_FILTER) -> dict[str, DataFrame]:
    """Nine result sets under one filter; ship modes are never filtered.

    The order frame therefore holds all orders, with or without a known customer
    and place, and the filter picks among its rows.
    """
    goods = _goods(star, flt)
    measures = tuple(dict.fromkeys([*rollups.KPI_PARTIALS, *PRICED, "line_count"]))
    columns = ["order_id_raw", "customer_id", "segment", KNOWN, "region", "market", PLACED, "order_date", "ship_mode", "ship_date"]
    every = stored(order_totals(star, measures, columns, optional=("customers", "locations")), "orders")
    orders = flt.apply(every)
    places = orders.where(PLACED).groupBy("region", "market").agg(*carried(PRICED), F.count(F.lit(1)).alias("orders"))

    def by_goods(key: str) -> DataFrame:
        return goods.where(STOCKED).groupBy(key).agg(*totalled(PRICED))

    def by_place(key: str) -> DataFrame:
        return places.groupBy(key).agg(*totalled(PRICED), F.sum("orders").alias("orders"))

    subcategories = by_goods("sub_category")
    return {
        "kpi": rollups.kpi_rows(orders),
        "revenue_by_year": rollups.year_rows(goods.groupBy("year").agg(*totalled(BASIC))),
        "sales_by_category": rollups.category_rows(by_goods("category")),
        "profit_by_market": rollups.market_rows(by_place("market")),
        "top_subcategory": rollups.subcategory_rows(subcategories),
        "orders_by_shipmode": rollups.shipmode_rows(every),
        "segment_stats": rollups.segment_rows_of(orders.where(KNOWN)),
        "region_stats": rollups.region_rows(by_place("region")),
        "quantity_stats": rollups.quantity_rows(subcategories),
    }


def region_drilldown(star: Star, region: str, limit: int = rollups.DRILL_ROWS) -> dict[str, DataFrame]:
    """Four result sets of one required region, plus the segment shares."""
    flt = rollups.required_region(region)
    goods = _goods(star, flt)
    orders = order_totals(star, BASIC, ["customer_id", "segment", KNOWN, "country"], flt, optional=("customers",))
    orders = stored(orders, "orders")
    segments = rollups.drill_segment_rows(rollups.segment_rows_of(orders.where(KNOWN)))
    return {
        "top_subcategories": rollups.drill_subcategory_rows(goods.where(STOCKED), limit),
        "segments": segments,
        "segment_share": rollups.segment_share(segments),
        "trend": rollups.drill_trend_rows(goods.groupBy("year").agg(*totalled(BASIC))),
        "top_countries": rollups.drill_country_rows(orders.groupBy("country").agg(*totalled(BASIC)), limit),
    }


def tidy(bundle: dict[str, DataFrame]) -> DataFrame:
    """All members in one long frame: section, label, measure, value."""
    whole = None
    for section, frame in bundle.items():
        texts = [n for n, t in frame.dtypes if t == "string" or n == "year"]
        numbers = [n for n, _ in frame.dtypes if n not in texts]
        label = F.concat_ws("/", *[F.col(n).cast("string") for n in texts]) if texts else F.lit("")
        cells = F.explode(
            F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("value")) for n in numbers])
        ).alias("cell")
        part = frame.select(F.lit(section).alias("section"), label.alias("label"), cells).select(
        "section", "label", "cell.measure", "cell.value"
        )
        whole = part if whole is None else whole.unionByName(part)
    return whole
