"""Edge cases against SQLite, whose semantics the queries must keep."""

import pytest

from salesloom.operators import geography, listings, rollups
from salesloom.plans.bundles import dashboard_summary, region_drilldown
from salesloom.plans.filters import Filter

JOINED = """
WITH f AS (
  SELECT i.row_id, i.order_key, i.product_id, i.sales, i.profit, i.shipping_cost, i.discount, i.quantity, i.year, i.week_num,
         h.order_id_raw, h.customer_id, h.order_date, h.ship_date, h.ship_mode, h.order_priority,
         c.customer_id AS known_customer, c.customer_name, c.segment,
         p.product_id AS known_product, p.product_name, p.category, p.sub_category,
         g.location_id AS known_place, g.city, g.country, g.region, g.market,
         i.sales * 1.0 / NULLIF(i.quantity, 0) AS unit_price
  FROM order_items i INNER JOIN orders h USING (order_key)
  LEFT JOIN dim_customers c ON c.customer_id = h.customer_id
  LEFT JOIN dim_products p ON p.product_id = i.product_id
  LEFT JOIN dim_locations g ON g.location_id = h.location_id)
"""
SUMS = "ROUND(SUM(sales), 2) sales, ROUND(SUM(profit), 2) profit, SUM(quantity) quantity"
PRICE = "ROUND(AVG(unit_price), 2) avg_unit_price"
LISTED = "known_customer IS NOT NULL AND known_product IS NOT NULL AND known_place IS NOT NULL"


def same(frame, db, sql, ordered=True):
    theirs = [dict(r) for r in db.execute(sql)]
    ours = [r.asDict() for r in frame.collect()]

    def norm(row):
        return {k: (round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v) for k, v in row.items()}

    ours, theirs = [norm(r) for r in ours], [norm(r) for r in theirs]
    if not ordered:
        key = lambda r: sorted((k, str(v)) for k, v in r.items())
        ours, theirs = sorted(ours, key=key), sorted(theirs, key=key)
    assert ours == theirs


FILTERS = [
    (Filter(), "1"),
    (Filter(date_start="2014-06-01", date_end="2014-12-31"), "substr(order_date, 1, 10) BETWEEN '2014-06-01' AND '2014-12-31'"),
    (Filter(region="North"), "region = 'North'"),
    (Filter(market="APAC", date_end="2014-12-30"), "market = 'APAC' AND substr(order_date, 1, 10) <= '2014-12-30'"),
    (Filter(region="  ", market=""), "1"),
    (Filter(region="nowhere"), "region = 'nowhere'"),
]


@pytest.mark.parametrize("flt,where", FILTERS)
def test_kpi(edge, edge_db, flt, where):
    same(
        rollups.kpi(edge, flt),
        edge_db,
        JOINED
        + f"""SELECT ROUND(SUM(sales), 2) total_revenue, ROUND(SUM(profit), 2) total_profit,
        COUNT(DISTINCT order_id_raw) total_orders, COUNT(DISTINCT customer_id) total_customers,
        ROUND(AVG(discount) * 100, 1) avg_discount_pct, ROUND(SUM(shipping_cost), 2) total_shipping_cost,
        COUNT(row_id) total_items, ROUND(AVG(quantity), 1) avg_quantity, SUM(quantity) total_quantity,
        ROUND(SUM(sales) / NULLIF(COUNT(DISTINCT order_key), 0), 2) avg_order_value,
        ROUND(COUNT(row_id) * 1.0 / NULLIF(COUNT(DISTINCT order_key), 0), 1) avg_items_per_order FROM f WHERE {where}""",
    )


@pytest.mark.parametrize("flt,where", FILTERS)
def test_filtered_rollups(edge, edge_db, flt, where):
    cases = {
        "revenue_by_year": f"""SELECT year, ROUND(SUM(sales), 2) revenue, ROUND(SUM(profit), 2) profit, SUM(quantity) quantity
            FROM f WHERE {where} GROUP BY year""",
        "sales_by_category": f"SELECT category, {SUMS}, {PRICE} FROM f WHERE known_product IS NOT NULL AND {where} GROUP BY category",
        "top_subcategory": f"SELECT sub_category, {SUMS}, {PRICE} FROM f WHERE known_product IS NOT NULL AND {where} GROUP BY 1",
        "profit_by_market": f"SELECT market, {SUMS} FROM f WHERE known_place IS NOT NULL AND {where} GROUP BY market",
        "segment_stats": f"""SELECT segment, COUNT(DISTINCT customer_id) customers, COUNT(DISTINCT order_key) orders, {SUMS}
            FROM f WHERE known_customer IS NOT NULL AND {where} GROUP BY segment""",
        "region_stats": f"""SELECT region, COUNT(DISTINCT order_key) orders, {SUMS}, {PRICE}
            FROM f WHERE known_place IS NOT NULL AND {where} GROUP BY region""",
    }
    for name, sql in cases.items():
        same(getattr(rollups, name)(edge, flt), edge_db, JOINED + sql, ordered=False)


@pytest.mark.parametrize("flt", [FILTERS[0][0], FILTERS[3][0]])
def test_bundle_members_equal_single_queries(edge, flt):
    bundle = dashboard_summary(edge, flt)
    assert len(bundle) == 9
    for name, frame in bundle.items():
        single = getattr(rollups, name)
        alone = single(edge) if name == "orders_by_shipmode" else single(edge, flt)
        assert frame.columns == alone.columns
        assert frame.collect() == alone.collect(), name


def test_drilldown_members_equal_single_queries(edge):
    bundle = region_drilldown(edge, "North")
    assert bundle["top_subcategories"].collect() == rollups.drill_subcategories(edge, "North").collect()
    assert bundle["trend"].collect() == rollups.drill_trend(edge, "North").collect()
    assert bundle["top_countries"].collect() == rollups.drill_countries(edge, "North").collect()
    with pytest.raises(ValueError):
        region_drilldown(edge, " ")


def test_lead_time_is_weighted_by_lines(edge, edge_db):
    days = "ROUND(AVG(JULIANDAY(ship_date) - JULIANDAY(order_date)), 1) avg_shipping_days"
    for key, name in (("ship_mode", "orders_by_shipmode"), ("order_priority", "orders_by_priority")):
        value = ", ROUND(SUM(sales) / COUNT(DISTINCT order_key), 2) avg_order_value" if key == "ship_mode" else ""
        sql = f"SELECT {key}, COUNT(DISTINCT order_key) order_count, ROUND(SUM(sales), 2) total_sales{value}, {days} FROM f GROUP BY {key}"
        same(getattr(rollups, name)(edge), edge_db, JOINED + sql, ordered=False)


def test_margin_of_zero_sales_is_null(edge, edge_db):
    same(
        rollups.profit_margin_trend(edge),
        edge_db,
        """SELECT year, ROUND(SUM(sales), 2) sales, ROUND(SUM(profit), 2) profit,
        ROUND(SUM(profit) / NULLIF(SUM(sales), 0) * 100, 2) margin_pct FROM order_items GROUP BY year ORDER BY year""",
    )


def test_weekly_trend_needs_no_header(edge, edge_db):
    same(
        rollups.weekly_trend(edge),
        edge_db,
        """SELECT year, week_num, ROUND(SUM(sales), 2) sales, ROUND(SUM(profit), 2) profit FROM order_items
        GROUP BY year, week_num ORDER BY year, week_num""",
    )


def test_unsold_and_orderless_rows_are_kept(edge, edge_db):
    same(
        listings.products_page(edge),
        edge_db,
        """SELECT p.product_id, category, sub_category, product_name, ROUND(AVG(sales), 2) avg_sales,
        ROUND(SUM(profit), 2) total_profit, COUNT(row_id) times_sold FROM dim_products p
        LEFT JOIN order_items i ON i.product_id = p.product_id GROUP BY p.product_id
        ORDER BY total_profit DESC, p.product_id""",
    )
    tail = "LEFT JOIN order_items i ON i.order_key = h.order_key GROUP BY 1, 2, 3"
    same(
        listings.customers_page(edge),
        edge_db,
        f"""SELECT c.customer_id, customer_name, segment, COUNT(DISTINCT h.order_key) total_orders,
        ROUND(SUM(sales), 2) total_sales, ROUND(SUM(profit), 2) total_profit, ROUND(AVG(discount) * 100, 1) avg_discount
        FROM dim_customers c LEFT JOIN orders h ON h.customer_id = c.customer_id {tail}
        ORDER BY total_sales DESC, c.customer_id""",
    )
    same(
        listings.locations_page(edge),
        edge_db,
        f"""SELECT g.location_id, city, state, country, region, market, COUNT(DISTINCT h.order_key) total_orders,
        ROUND(SUM(sales), 2) total_sales, ROUND(SUM(profit), 2) total_profit
        FROM dim_locations g LEFT JOIN orders h ON h.location_id = g.location_id {tail}, 4, 5, 6
        ORDER BY total_sales DESC, g.location_id""",
    )


@pytest.mark.parametrize("text", ["a-1", "%", "_", "b_2", "\\", "'", "É", "é", "DRONE", "chair", "zzz", "o%n", "p_n"])
def test_search_is_like(edge, edge_db, text):
    pattern = f"%{text}%"
    where = " OR ".join(f"{c} LIKE ?" for c in ("product_name", "category", "sub_category"))
    theirs = edge_db.execute(f"SELECT product_id FROM dim_products WHERE {where}", [pattern] * 3).fetchall()
    ours = listings.products_rollup(edge, text).select("product_id").collect()
    assert sorted(r[0] for r in ours) == sorted(r[0] for r in theirs)

    six = ("order_id_raw", "customer_name", "category", "sub_category", "country", "ship_mode")
    where = " OR ".join(f"{c} LIKE ?" for c in six)
    theirs = edge_db.execute(JOINED + f"SELECT order_id_raw FROM f WHERE {LISTED} AND ({where})", [pattern] * 6).fetchall()
    listing = listings.orders_listing(edge, text)
    assert sorted(r["order_id_raw"] for r in listing.collect()) == sorted(r[0] for r in theirs)
    totals = {r["listing"]: r["total"] for r in listings.pagination_counts(edge, text).collect()}
    assert totals["orders"] == len(theirs) and totals["products"] == len(ours)


def test_counts_without_search(edge, edge_db):
    totals = {r["listing"]: r["total"] for r in listings.pagination_counts(edge).collect()}
    lines = edge_db.execute(JOINED + f"SELECT COUNT(*) FROM f WHERE {LISTED}").fetchone()[0]
    assert totals == {"orders": lines, "products": 5, "customers": 4, "locations": 4}


def test_pages_join_up_to_the_listing(star):
    for name, lead in (("products_rollup", "total_profit"), ("customers_rollup", "total_sales")):
        frame = getattr(listings, name)(star)
        whole = frame.orderBy(*listings.listing_order(frame, lead)).collect()
        size, pages = 37, []
        for number in range(1, listings.page_count(len(whole), size) + 1):
            pages += listings.page_of(frame, lead, number, size).collect()
        assert pages == whole
        keyset, last = [], None
        while True:
            page = listings.page_after(frame, lead, last, size).collect()
            if not page:
                break
            keyset += page
            last = page[-1].asDict()
        assert keyset == whole


def test_every_offset_is_found_by_rank(star):
    frame = listings.orders_listing(star)
    order = listings.listing_order(frame, "order_date")
    whole = frame.orderBy(*order).collect()
    for offset in (0, 1234, 5990):
        assert listings.rows_at(frame, "order_date", offset, 25, span=50).collect() == whole[offset : offset + 25]


def test_rank_selection_with_ties_nulls_and_texts(spark):
    """Few values, long common text beginnings, nulls in every column and repeated rows."""
    rows = [
        (None if k % 7 == 0 else k % 3, None if k % 11 == 0 else f"the same beginning {'é' * (k % 4)}{k % 5}", k % 2 == 0, float(k % 13) if k % 3 else None)
        for k in range(900)
    ]
    frame = spark.createDataFrame(rows, "lead int, name string, flag boolean, amount double").repartition(5)
    whole = frame.orderBy(*listings.listing_order(frame, "lead")).collect()
    for offset in (11, 258, 600, 771, 885, 899, 2000):
        for size in (1, 300):
            assert listings.rows_at(frame, "lead", offset, size, span=10).collect() == whole[offset : offset + size]
    assert listings.rows_at(frame.limit(0), "lead", 50, 20, span=10).collect() == []


def test_page_request():
    assert listings.page_request("3", "50") == (3, 50)
    assert listings.page_request("x", "50") == (1, 20)
    assert listings.page_request(2, "1.5") == (1, 20)
    assert listings.page_request() == (1, 20)


# --- Country panel, brute force -------------------------------------------


def panel_lines(db, country, keep):
    rows = [dict(r) for r in db.execute(JOINED + f"SELECT * FROM f WHERE {LISTED} AND country = ?", [country])]
    return [r for r in rows if keep(r["order_date"] or "")]


@pytest.mark.parametrize(
    "kwargs,keep",
    [
        ({}, lambda d: True),
        ({"window": ("2014-01-01", "2014-12-31")}, lambda d: "2014-01-01" <= d[:10] <= "2014-12-31"),
        ({"day": "2014-12-31"}, lambda d: d[:10] == "2014-12-31"),
        ({"day": "1999-01-01"}, lambda d: False),
    ],
)
@pytest.mark.parametrize("country", ["Norway", "Australia", "Chad"])
def test_country_panel(edge, edge_db, country, kwargs, keep):
    rows = panel_lines(edge_db, country, keep)
    sales, profit, shipping = (sum(round(r[c] + 1e-9, 2) for r in rows) for c in ("sales", "profit", "shipping_cost"))
    raw = {r["order_id_raw"] for r in rows}
    got = geography.country_stats(edge, country, **kwargs).collect()
    assert len(got) == 1
    got = got[0]
    assert got["sales"] == pytest.approx(sales) and got["profit"] == pytest.approx(profit, abs=0.011)
    assert (got["units"], got["line_items"], got["orders"]) == (sum(r["quantity"] for r in rows), len(rows), len(raw))
    assert got["shipping_per_order"] == pytest.approx(shipping / len(raw) if raw else 0)
    assert got["margin_pct"] == pytest.approx(profit / sales * 100 if sales > 0 else 0, abs=0.02)

    modes = {}
    for r in sorted(rows, key=lambda r: (r["order_date"] or "", r["ship_mode"] or "Standard Class"), reverse=True):
        modes.setdefault(r["order_id_raw"], r["ship_mode"] or "Standard Class")
    panel = geography.country_shipmode(edge, country, **kwargs).collect()
    assert sorted(r["ship_mode"] for r in panel) == sorted(geography.SHIP_MODES)
    for r in panel:
        mine = [x for x in rows if (x["ship_mode"] or "Standard Class") == r["ship_mode"]]
        count = sum(1 for m in modes.values() if m == r["ship_mode"])
        assert r["orders"] == count
        assert r["sales"] == pytest.approx(sum(x["sales"] for x in mine))
        assert r["order_share_pct"] == pytest.approx(100 * count / len(raw) if raw else 0)


def test_catalog_adds_up(star):
    catalog = geography.country_catalog(star).collect()
    assert sum(r["orders"] for r in catalog) == 1500


def test_highlight(edge):
    neutral = geography.country_highlight(edge).collect()
    assert {r["state"] for r in neutral} == {"neutral"}
    marked = {r["country"]: r["state"] for r in geography.country_highlight(edge, Filter(region="North", market="EU")).collect()}
    assert marked == {"Norway": "matched", "Australia": "dimmed"}


def test_money_sums_are_exact_beyond_64_bits(spark):
    from decimal import Decimal

    from edge_star import CUSTOMERS, LOCATIONS, NAMES, ORDERS, PRODUCTS

    from salesloom.plans.fact import line_totals
    from salesloom.sources.star import star_of

    big = Decimal("99999999999999.9999")
    amounts = [big] * 40 + [-big] * 9 + [Decimal("0.0001")] * 3 + [Decimal("-0.0003")]
    rows = [(i, 1, "p1", a, -a, a, Decimal("0.1"), 1, 2014, 1) for i, a in enumerate(amounts)]
    kinds = "bigint bigint string decimal(18,4) decimal(18,4) decimal(18,4) decimal(6,4) int int int".split()
    frames = {"order_items": spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in zip(NAMES["order_items"][0].split(), kinds)))}
    for table, data in (("orders", ORDERS), ("dim_customers", CUSTOMERS), ("dim_products", PRODUCTS), ("dim_locations", LOCATIONS)):
        columns, _, types = NAMES[table]
        frames[table] = spark.createDataFrame(data, ", ".join(f"{c} {k}" for c, k in zip(columns.split(), types.split())))
    large = star_of(**frames)
    got = line_totals(large, ["year"], ("sales", "profit")).first()
    assert got["sales"] == sum(amounts) and got["profit"] == -sum(amounts)
    assert rollups.profit_by_market(large).first()["sales"] == float(round(sum(amounts), 2))


def test_registered_views(spark, edge):
    from salesloom.sources.star import register_views

    register_views(edge.tables)
    assert spark.sql("SELECT COUNT(*) FROM order_items JOIN orders USING (order_key)").first()[0] == 10


def test_parts_add_up_to_the_whole(star):
    region = "ASIA-0"
    row = next(r for r in rollups.region_stats(star).collect() if r["region"] == region)
    for part in (rollups.drill_segments(star, region), rollups.drill_trend(star, region), rollups.drill_countries(star, region, 100)):
        assert sum(r["sales"] for r in part.collect()) == pytest.approx(row["sales"])
    assert sum(r["orders"] for r in rollups.drill_segments(star, region).collect()) == row["orders"]

    whole = rollups.kpi(star).first()
    markets = rollups.profit_by_market(star).collect()
    split = [rollups.kpi(star, Filter(market=r["market"])).first() for r in markets]
    for name in ("total_orders", "total_items", "total_quantity", "total_customers"):
        assert sum(r[name] for r in split) == whole[name]
    early, late = Filter(date_end="1997-12-31"), Filter(date_start="1998-01-01")
    assert sum(rollups.kpi(star, f).first()["total_items"] for f in (early, late)) == whole["total_items"]
    share = rollups.segment_share(rollups.drill_segments(star, region)).collect()
    assert sum(r["share_pct"] for r in share) == pytest.approx(100, abs=0.3)
