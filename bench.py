"""Times the headline queries and prints one JSON line.

Each query is run once to warm up and then three times, its result written to
the no-op sink, with nothing cached; the median counts. Model fits are left out:
with their full number of trees they take minutes.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from salesloom import catalog
from salesloom.session import local_session

HEADLINE = (
    "kpi", "kpi_filtered", "revenue_by_year", "sales_by_category", "profit_by_market", "top_subcategory",
    "quantity_stats", "segment_stats", "region_stats", "region_stats_filtered", "orders_by_shipmode",
    "orders_by_priority", "weekly_trend", "profit_margin_trend", "monthly_sales_trend", "profit_histogram",
    "profit_vs_discount", "drill_subcategories", "drill_segments", "drill_countries", "dashboard_summary",
    "region_drilldown", "line_fact", "orders_page", "orders_page_search", "products_page", "customers_page",
    "locations_page", "pagination_counts", "country_catalog", "country_stats", "country_shipmode",
    "features_profit", "features_priority", "onehot_features", "features_scaled", "class_weights",
    "validation_report", "what_if_grid", "classification_report", "confusion_crosstab",
)
REPEATS = 3


def timed(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "bench", int(cores))
    queries = catalog.queries()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        timed(lambda: queries[name](spark, path))
        taken = []
        for _ in range(REPEATS):
            spark.catalog.clearCache()
            taken.append(timed(lambda: queries[name](spark, path)))
        seconds[name] = statistics.median(taken)
    seconds = {n: round(s, 3) for n, s in seconds.items()}
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of median seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(path.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
