"""What the plans must look like: pruned scans, no cross joins, split skew."""

import contextlib
import io

import pytest
from compare import SMALL
from pyspark.sql import functions as F

from salesloom import catalog
from salesloom.operators import listings, rollups
from salesloom.plans.filters import Filter
from salesloom.sources.star import star_of


def plan(frame) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain("formatted")
    return out.getvalue()


@contextlib.contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_scans_are_pruned_and_filtered(star):
    text = plan(rollups.revenue_by_year(star, Filter("1996-01-01", "1998-12-31")))
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text
    assert "l_returnflag" not in text and "c_custkey" not in text and "n_name" not in text


def test_no_query_pairs_everything_or_runs_python(spark):
    fits = ("train_", "score_", "report_", "what_if_c", "what_if_b", "save_", "decision", "stored_", "read_", "export_")
    for name, run in catalog.queries().items():
        if name.startswith(fits):
            continue
        text = plan(run(spark, SMALL))
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
            assert bad not in text, (name, bad)


def test_pages_are_top_k(star):
    for frame in (listings.orders_page(star, page=2), listings.products_page(star), listings.locations_page(star, page=3)):
        assert "TakeOrderedAndProject" in plan(frame)


def test_order_totals_join_unique_keys(spark, star):
    """Lines are summed per order before the header join."""
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        text = plan(rollups.kpi(star))
    tree = text[: text.index("\n(1) ")]
    join = tree.index("SortMergeJoin Inner")
    assert "HashAggregate" in tree[join:]


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all lines in one order, of one product and one customer."""
    n = 60_000
    line = spark.range(n)
    hot = F.col("id") % 3 == 0
    items = line.select(
        F.col("id").alias("row_id"),
        F.when(hot, 0).otherwise(F.col("id") % 5000 + 1).alias("order_key"),
        F.when(hot, 0).otherwise(F.col("id") % 900 + 1).alias("product_id"),
        (F.col("id") % 100 + 1).cast("double").alias("sales"),
        (F.col("id") % 7 - 2).cast("double").alias("profit"),
        F.lit(1.0).alias("shipping_cost"),
        F.lit(0.1).alias("discount"),
        (F.col("id") % 9 + 1).cast("int").alias("quantity"),
        F.lit(2014).alias("year"),
        F.lit(1).alias("week_num"),
    )
    orders = spark.range(5001).select(
        F.col("id").alias("order_key"),
        F.concat(F.lit("O"), "id").alias("order_id_raw"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 700 + 1).alias("customer_id"),
        (F.col("id") % 4).alias("location_id"),
        F.lit("2014-05-05").alias("order_date"),
        F.lit("2014-05-08").alias("ship_date"),
        F.lit("Same Day").alias("ship_mode"),
        F.lit("High").alias("order_priority"),
    )
    people = spark.range(701).select(
        F.col("id").alias("customer_id"), F.concat(F.lit("c"), "id").alias("customer_name"), F.lit("Consumer").alias("segment")
    )
    goods = spark.range(901).select(
        F.col("id").alias("product_id"),
        F.concat(F.lit("p"), "id").alias("product_name"),
        F.lit("Technology").alias("category"),
        (F.col("id") % 5).cast("string").alias("sub_category"),
    )
    places = spark.range(4).select(
        F.col("id").alias("location_id"),
        *[F.concat(F.lit(c), "id").alias(c) for c in ("city", "state", "country", "region", "market")],
    )
    return star_of(order_items=items, orders=orders, dim_customers=people, dim_products=goods, dim_locations=places)


def final_plan(frame) -> str:
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def test_hot_product_and_order_are_split(spark, skewed):
    tight = {
        "spark__sql__autoBroadcastJoinThreshold": "-1",
        "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
        "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "64k",
        "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "2",
        "spark__sql__adaptive__advisoryPartitionSizeInBytes": "32k",
        "spark__sql__adaptive__coalescePartitions__enabled": "false",
        "spark__sql__shuffle__partitions": "16",
    }
    expected = rollups.top_subcategory(skewed).collect()
    with settings(spark, **tight):
        frame = rollups.top_subcategory(skewed)
        assert "SortMergeJoin(skew=true)" in final_plan(frame)
        assert [r["sales"] for r in frame.collect()] == [r["sales"] for r in expected]


def test_hot_order_is_one_row_at_the_header_join(spark, skewed):
    """The per-order sums shrink the hot order on the map side."""
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1"):
        rows = rollups.region_stats(skewed).collect()
        kpi = rollups.kpi(skewed).first()
    assert sum(r["orders"] for r in rows) == 5001 - _orders_without_lines()
    assert kpi["total_items"] == 60_000


def _orders_without_lines() -> int:
    used = {0 if i % 3 == 0 else i % 5000 + 1 for i in range(60_000)}
    return 5001 - len(used)


def test_filtered_rollups_drop_lines_before_the_sum(spark, star):
    """The filter's order keys meet the lines below the first sum, in a plain session."""
    flt = Filter("1996-01-01", "1996-12-31", market="EU")
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        text = rollups.region_stats(star, flt)._jdf.queryExecution().optimizedPlan().toString()
    rows = text.splitlines()
    semi = next(n for n, line in enumerate(rows) if "Join LeftSemi" in line)
    sums = [n for n, line in enumerate(rows) if "Aggregate" in line and "order_key" in line.replace("l_orderkey", "order_key")]
    assert sums and max(n for n in sums if n < semi) < semi
    assert not [n for n in sums if n > semi]


def test_line_rollups_do_not_read_orders(spark, star):
    for frame in (rollups.profit_histogram(star), rollups.profit_vs_discount(star), rollups.net_status_counts(star)):
        assert "o_orderkey" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_nothing_stays_cached(spark, star):
    from salesloom.plans.bundles import dashboard_summary, tidy

    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    tidy(dashboard_summary(star)).collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_triage_trains_on_the_tables_discounts(spark, star):
    from salesloom.operators.training import training_features
    from salesloom.sources.transactions import star_transactions

    most = star_transactions(star).agg(F.max("discount") / 100).first()[0]
    assert training_features(star, "priority").agg(F.max("discount")).first()[0] == most < 1


def test_best_discount_shuffles_once(spark, star, monkeypatch):
    from salesloom.operators import scoring
    from salesloom.sources.transactions import star_transactions

    monkeypatch.setattr(scoring, "predicted", lambda model, f: f.withColumn("prediction", F.col("total_cost_spent")))
    inputs = scoring.numbered_inputs(star_transactions(star))
    text = scoring.best_discounts(inputs, None)._jdf.queryExecution().executedPlan().toString()
    above_sweep = text[: text.index("Generate explode(")]
    assert "Exchange" not in above_sweep
    assert "Sort" not in above_sweep


def test_far_pages_are_top_k_of_a_range(star):
    """A far page filters to the range of its rank and holds few rows; the listing is never sorted whole."""
    frame = listings.orders_page(star, page=201, limit=20, span=100)
    text = plan(frame)
    assert "TakeOrderedAndProject" in text and "Exchange rangepartitioning" not in text
    assert "PushedFilters" in text and "o_orderdate" in text
    assert len(frame.collect()) == 20


def scans(frame, column: str) -> int:
    """How often the leaves of a plan read a column."""
    return sum("Relation" in line and column in line for line in frame._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_ship_dates_come_with_the_sums(star):
    for frame in (rollups.orders_by_shipmode(star), rollups.orders_by_priority(star)):
        assert scans(frame, "l_orderkey") == 1


def test_country_panels_sum_the_lines_of_their_orders(spark, star):
    from salesloom.operators.geography import country_stats

    rows = country_stats(star, "NATION_2")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    semi = next(n for n, line in enumerate(rows) if "Join LeftSemi" in line)
    sums = [n for n, line in enumerate(rows) if "Aggregate" in line and "order_key" in line]
    assert sums and not [n for n in sums if n > semi]


def test_dashboard_reads_the_lines_twice(star, monkeypatch):
    from salesloom.plans import bundles

    written = []
    monkeypatch.setattr(bundles, "stored", lambda frame, name: written.append(scans(frame, "l_orderkey")) or frame)
    bundles.dashboard_summary(star, Filter(market="APAC"))
    assert sum(written) == 2


def test_buckets_save_the_exchange_of_lines(spark, star, tmp_path):
    from salesloom.plans.fact import order_totals
    from salesloom.sources.export import write_star_tables
    from salesloom.sources.star import load_star_tables

    write_star_tables(star, f"{tmp_path}/star", "plan_star", 4)
    again = load_star_tables(spark, "plan_star", dated_lines=True)
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__shuffle__partitions="4"):
        totals = order_totals(again, ("sales",), ["order_date"])
        text = totals._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text and "Bucketed: true" in text
        dated = plan(rollups.revenue_by_year(again, Filter("1996-01-01", "1996-12-31")))
    assert "GreaterThanOrEqual(year,1996)" in dated and "LessThanOrEqual(year,1996)" in dated
    for flt in (Filter(), Filter("1996-02-01", "1997-03-31", market="EU")):
        for name in ("kpi", "revenue_by_year", "region_stats"):
            assert getattr(rollups, name)(again, flt).collect() == getattr(rollups, name)(star, flt).collect()
    for table in ("order_items", "orders", "dim_customers", "dim_products", "dim_locations"):
        spark.sql(f"DROP TABLE plan_star_{table}")


def test_search_compares_below_the_joins(star):
    """Texts are compared once per dimension row; joined lines carry flags."""
    text = listings.orders_page(star, "brand#1")._jdf.queryExecution().optimizedPlan().toString()
    rows = text.splitlines()
    likes = [n for n, row in enumerate(rows) if "LIKE" in row.upper() or "contains" in row.lower()]
    joins = [n for n, row in enumerate(rows) if "Join" in row]
    assert likes and min(likes) > min(joins)
    depth = lambda n: len(rows[n]) - len(rows[n].lstrip(" :+-"))
    line_join = max(n for n in joins if depth(n) == min(depth(m) for m in joins))
    assert all(depth(n) > depth(line_join) for n in likes)
