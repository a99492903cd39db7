"""The registered queries once more, as SQL for an independent engine.

The statements share nothing with the Spark plans: they join the whole star
per line and aggregate with plain ``COUNT(DISTINCT ...)``.
"""

from __future__ import annotations

# Texts shown with a decision, stated here once more so that nothing is shared.
URGENT_MESSAGE = "Pesanan ini berisiko tinggi / butuh penanganan segera!"
NORMAL_MESSAGE = "Pesanan reguler — penanganan standar operasional."
PRIORITY_MESSAGES = {
    "Critical": "Pesanan ini KRITIS — butuh penanganan segera / VIP!",
    "High": "Prioritas TINGGI — proses lebih cepat dari standar.",
    "Medium": "Prioritas SEDANG — tangani sesuai alur operasional biasa.",
    "Low": "Prioritas RENDAH — tidak mendesak, bisa dijadwalkan.",
}

STAR = """
s_products AS (
  SELECT p_partkey AS product_id, p_name AS product_name,
         CASE CAST(substr(p_brand, 7) AS INTEGER) % 3
              WHEN 0 THEN 'Furniture' WHEN 1 THEN 'Office Supplies' ELSE 'Technology' END AS category,
         p_brand AS sub_category, CAST(p_retailprice AS DECIMAL(10,2)) AS list_price
  FROM part),
s_customers AS (
  SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment, c_nationkey FROM customer),
s_locations AS (
  SELECT CAST(n_nationkey * 4 + k AS BIGINT) AS location_id, n_name || '-C' || k AS city,
         CAST(NULL AS VARCHAR) AS state, n_name AS country, r_name || '-' || (n_nationkey % 2) AS region,
         CASE r_name WHEN 'AFRICA' THEN 'Africa' WHEN 'AMERICA' THEN 'LATAM' WHEN 'ASIA' THEN 'APAC'
                     WHEN 'EUROPE' THEN 'EU' WHEN 'MIDDLE EAST' THEN 'EMEA' END AS market
  FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES (0), (1), (2), (3)) AS ks(k)),
s_orders AS (
  SELECT o_orderkey AS order_key, 'ORD-' || o_orderkey AS order_id_raw, o_custkey AS customer_id,
         CAST(c_nationkey * 4 + o_custkey % 4 AS BIGINT) AS location_id,
         o_orderdate AS order_date, ship_date,
         CASE o_orderstatus WHEN 'F' THEN 'Standard Class' WHEN 'O' THEN 'Second Class' WHEN 'P' THEN 'First Class' END AS ship_mode,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High' WHEN '5-LOW' THEN 'Low' ELSE 'Medium' END AS order_priority
  FROM orders JOIN s_customers ON o_custkey = customer_id
  LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS ship_date FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey),
s_items AS (
  SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS row_id, l_orderkey AS order_key, l_partkey AS product_id,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS sales,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
              - CAST(l_quantity AS INTEGER) * list_price AS DECIMAL(18,4)) AS profit,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS shipping_cost,
         CAST(l_discount AS DECIMAL(6,4)) AS discount, CAST(l_quantity AS INTEGER) AS quantity,
         CAST(year(o_orderdate) AS INTEGER) AS year, CAST(weekofyear(o_orderdate) AS INTEGER) AS week_num
  FROM lineitem JOIN s_products ON l_partkey = product_id JOIN orders ON l_orderkey = o_orderkey),
fact AS (
  SELECT i.*, o.order_id_raw, o.customer_id, o.location_id, o.order_date, o.ship_date, o.ship_mode, o.order_priority,
         c.customer_name, c.segment, p.product_name, p.category, p.sub_category,
         l.city, l.state, l.country, l.region, l.market,
         CAST(i.sales AS DOUBLE) / NULLIF(i.quantity, 0) AS unit_price
  FROM s_items i JOIN s_orders o ON i.order_key = o.order_key JOIN s_customers c ON o.customer_id = c.customer_id
  JOIN s_products p ON i.product_id = p.product_id JOIN s_locations l ON o.location_id = l.location_id)
"""

FILTER = "WHERE order_date >= DATE '1996-01-01' AND order_date < DATE '1999-01-01' AND market = 'APAC'"


def _sql(body: str, *steps: str) -> str:
    return "WITH " + ",\n".join([STAR, *steps]) + "\n" + body


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def cents(x: str, digits: int = 2) -> str:
    return f"CAST(ROUND({x}, {digits}) AS DOUBLE)"


def half_up(x: str, digits: int) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(28,10)), {digits}) AS DOUBLE)"


def mean(x: str, digits: int, times: str = "") -> str:
    return half_up(f"{dbl(f'SUM({x})')} / NULLIF(COUNT({x}), 0){times}", digits)


def text(x: str, digits: int) -> str:
    return f"CAST(CAST(ROUND(CAST({x} AS DECIMAL(28,10)), {digits}) AS DECIMAL(28,{digits})) AS VARCHAR)"


def compact(x: str) -> str:
    return (
        f"CASE WHEN {x} IS NULL THEN '—' ELSE CASE WHEN {x} < 0 THEN '-' ELSE '' END || '$' || "
        f"CASE WHEN abs({x}) >= 1e6 THEN {text(f'abs({x}) / CAST(1e6 AS DOUBLE)', 2)} || 'M' "
        f"WHEN abs({x}) >= 1e3 THEN {text(f'abs({x}) / CAST(1e3 AS DOUBLE)', 1)} || 'K' "
        f"ELSE {text(f'abs({x})', 2)} END END"
    )


def day(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


MONEY3 = f"{cents('SUM(sales)')} AS sales, {cents('SUM(profit)')} AS profit, {dbl('SUM(quantity)')} AS quantity"
PRICE = f"{half_up('AVG(unit_price)', 2)} AS avg_unit_price"
ORDERS = "COUNT(DISTINCT order_key)"


def _kpi(where: str) -> str:
    return f"""SELECT {cents('SUM(sales)')} AS total_revenue, {cents('SUM(profit)')} AS total_profit,
      COUNT(DISTINCT order_id_raw) AS total_orders, COUNT(DISTINCT customer_id) AS total_customers,
      {mean('discount', 1, ' * 100')} AS avg_discount_pct, {cents('SUM(shipping_cost)')} AS total_shipping_cost,
      COUNT(row_id) AS total_items, {mean('quantity', 1)} AS avg_quantity, {dbl('SUM(quantity)')} AS total_quantity,
      {half_up(f"{dbl('SUM(sales)')} / {ORDERS}", 2)} AS avg_order_value,
      {half_up(f"{dbl('COUNT(row_id)')} / {ORDERS}", 1)} AS avg_items_per_order FROM fact {where}"""


def _rollups(where: str) -> dict[str, str]:
    """The eight filtered rollups; the first element of each is one SELECT."""
    top = "ORDER BY {0} DESC NULLS LAST, sub_category LIMIT {1}"
    return {
        "kpi": _kpi(where),
        "revenue_by_year": f"""SELECT year, {cents('SUM(sales)')} AS revenue, {cents('SUM(profit)')} AS profit,
            {dbl('SUM(quantity)')} AS quantity FROM fact {where} GROUP BY year""",
        "sales_by_category": f"SELECT category, {MONEY3}, {PRICE} FROM fact {where} GROUP BY category",
        "profit_by_market": f"SELECT market, {MONEY3} FROM fact {where} GROUP BY market",
        "top_subcategory": f"""SELECT sub_category, {MONEY3}, {PRICE} FROM fact {where} GROUP BY sub_category
            {top.format('sales', 10)}""",
        "quantity_stats": f"""SELECT sub_category, {cents('SUM(sales)')} AS revenue, {dbl('SUM(quantity)')} AS quantity,
            {PRICE}, {cents('SUM(profit)')} AS profit FROM fact {where} GROUP BY sub_category
            {top.format('revenue', 12)}""",
        "segment_stats": f"""SELECT segment, COUNT(DISTINCT customer_id) AS customers, {ORDERS} AS orders, {MONEY3}
            FROM fact {where} GROUP BY segment""",
        "region_stats": f"""SELECT region, {cents('SUM(sales)')} AS sales, {cents('SUM(profit)')} AS profit,
            {ORDERS} AS orders, {dbl('SUM(quantity)')} AS quantity, {PRICE} FROM fact {where} GROUP BY region""",
    }


DAYS = "date_diff('day', CAST(order_date AS DATE), CAST(ship_date AS DATE))"
SHIPMODE = f"""SELECT ship_mode, {ORDERS} AS order_count, {cents('SUM(sales)')} AS total_sales,
    {half_up(f"{dbl('SUM(sales)')} / {ORDERS}", 2)} AS avg_order_value,
    {half_up(f'AVG({DAYS})', 1)} AS avg_shipping_days FROM fact GROUP BY ship_mode"""

IN_REGION = "WHERE region = 'ASIA-0'"
DRILL = {
    "drill_subcategories": f"""SELECT sub_category, min(category) AS category, {MONEY3}, {PRICE} FROM fact {IN_REGION}
        GROUP BY sub_category ORDER BY sales DESC, sub_category LIMIT 8""",
    "drill_segments": f"SELECT segment, {MONEY3}, {ORDERS} AS orders FROM fact {IN_REGION} GROUP BY segment",
    "drill_trend": f"SELECT year, {MONEY3} FROM fact {IN_REGION} GROUP BY year",
    "drill_countries": f"""SELECT country, {MONEY3} FROM fact {IN_REGION} GROUP BY country
        ORDER BY sales DESC, country LIMIT 8""",
}
SHARE = f"""SELECT segment, sales, quantity,
    CASE WHEN SUM(sales) OVER () > 0 THEN {half_up('sales / SUM(sales) OVER () * 100', 1)} ELSE 0.0 END AS share_pct
    FROM ({DRILL['drill_segments']})"""


def _tidy(sections: dict[str, tuple[str, str, list[str]]]) -> str:
    """Long form of several selects: section, label, measure, value."""
    parts = [
        f"SELECT '{section}' AS section, {label} AS label, '{m}' AS measure, CAST({m} AS DOUBLE) AS value FROM ({body})"
        for section, (body, label, measures) in sections.items()
        for m in measures
    ]
    return "\nUNION ALL\n".join(parts)


_M3, _P = ["sales", "profit", "quantity"], ["avg_unit_price"]
_KPIS = [
    "total_revenue", "total_profit", "total_orders", "total_customers", "avg_discount_pct", "total_shipping_cost",
    "total_items", "avg_quantity", "total_quantity", "avg_order_value", "avg_items_per_order",
]


def _dashboard() -> str:
    r = _rollups(FILTER)
    return _tidy(
        {
            "kpi": (r["kpi"], "''", _KPIS),
            "revenue_by_year": (r["revenue_by_year"], "CAST(year AS VARCHAR)", ["revenue", "profit", "quantity"]),
            "sales_by_category": (r["sales_by_category"], "category", _M3 + _P),
            "profit_by_market": (r["profit_by_market"], "market", _M3),
            "top_subcategory": (r["top_subcategory"], "sub_category", _M3 + _P),
            "orders_by_shipmode": (
                SHIPMODE,
                "ship_mode",
                ["order_count", "total_sales", "avg_order_value", "avg_shipping_days"],
            ),
            "segment_stats": (r["segment_stats"], "segment", ["customers", "orders", *_M3]),
            "region_stats": (r["region_stats"], "region", ["sales", "profit", "orders", "quantity", *_P]),
            "quantity_stats": (r["quantity_stats"], "sub_category", ["revenue", "quantity", *_P, "profit"]),
        }
    )


def _drilldown() -> str:
    return _tidy(
        {
            "top_subcategories": (DRILL["drill_subcategories"], "sub_category || '/' || category", _M3 + _P),
            "segments": (DRILL["drill_segments"], "segment", [*_M3, "orders"]),
            "segment_share": (SHARE, "segment", ["sales", "quantity", "share_pct"]),
            "trend": (DRILL["drill_trend"], "CAST(year AS VARCHAR)", _M3),
            "top_countries": (DRILL["drill_countries"], "country", _M3),
        }
    )


# --- Listings -------------------------------------------------------------


def _like(pattern: str, *columns: str) -> str:
    return "(" + " OR ".join(f"{c} ILIKE '%{pattern}%'" for c in columns) + ")"


_ORDER_TEXT = ("order_id_raw", "customer_name", "category", "sub_category", "country", "ship_mode")
LISTING = f"""SELECT order_id_raw, customer_name, segment, category, sub_category, product_name,
    {cents('sales')} AS sales, {cents('profit')} AS profit, {cents('discount * 100', 1)} AS discount_pct, quantity,
    {cents('shipping_cost')} AS shipping_cost, ship_mode, order_priority, {day('order_date')} AS order_date,
    {day('ship_date')} AS ship_date, city, country, market, region FROM fact"""
_REST = """order_id_raw, customer_name, segment, category, sub_category, product_name, sales, profit, discount_pct,
    quantity, shipping_cost, ship_mode, order_priority, ship_date, city, country, market, region"""


def _orders_page(where: str, offset: int, limit: int) -> str:
    return f"""SELECT * FROM ({LISTING} {where}) ORDER BY order_date DESC NULLS LAST, {_REST}
        LIMIT {limit} OFFSET {offset}"""


def _products(where: str = "") -> str:
    return f"""SELECT product_id, category, sub_category, product_name, {mean('sales', 2)} AS avg_sales,
        {cents('SUM(profit)')} AS total_profit, COUNT(row_id) AS times_sold
        FROM s_products LEFT JOIN s_items USING (product_id) {where} GROUP BY ALL"""


def _customers(where: str = "") -> str:
    return f"""SELECT c.customer_id, customer_name, segment, COUNT(DISTINCT o.order_key) AS total_orders,
        {cents('SUM(sales)')} AS total_sales, {cents('SUM(profit)')} AS total_profit,
        {mean('discount', 1, ' * 100')} AS avg_discount
        FROM s_customers c LEFT JOIN s_orders o ON c.customer_id = o.customer_id
        LEFT JOIN s_items i ON o.order_key = i.order_key {where} GROUP BY ALL"""


def _locations(where: str = "") -> str:
    return f"""SELECT l.location_id, city, state, country, region, market, COUNT(DISTINCT o.order_key) AS total_orders,
        {cents('SUM(sales)')} AS total_sales, {cents('SUM(profit)')} AS total_profit
        FROM s_locations l LEFT JOIN s_orders o ON l.location_id = o.location_id
        LEFT JOIN s_items i ON o.order_key = i.order_key {where} GROUP BY ALL"""


def _totals(text_: str | None) -> str:
    def where(*columns: str) -> str:
        return f"WHERE {_like(text_, *columns)}" if text_ else ""

    return f"""SELECT 'orders' AS listing, COUNT(*) AS total FROM fact {where(*_ORDER_TEXT)}
      UNION ALL SELECT 'products', COUNT(*) FROM s_products {where('product_name', 'category', 'sub_category')}
      UNION ALL SELECT 'customers', COUNT(DISTINCT customer_id) FROM s_customers {where('customer_name', 'segment')}
      UNION ALL SELECT 'locations', COUNT(*) FROM s_locations {where('city', 'country', 'region', 'market')}"""


# --- Country panel --------------------------------------------------------


def _window(kind: str) -> str:
    return {
        "all": "order_date >= DATE '1995-01-01' AND order_date < DATE '2001-08-02'",
        "q4": "order_date >= DATE '1997-10-01' AND order_date < DATE '1998-01-01'",
        "day": "CAST(order_date AS DATE) = DATE '1997-05-28'",
    }[kind]


def _zero(x: str) -> str:
    return f"COALESCE(CAST(SUM(ROUND({x}, 2)) AS DOUBLE), 0.0)"


def _safe(top: str, bottom: str, times: str = "") -> str:
    return f"CASE WHEN {bottom} > 0 THEN {top} / {bottom}{times} ELSE 0.0 END"


def _country_stats(country: str, window: str) -> str:
    return f"""SELECT *, {_safe('profit', 'sales', ' * 100')} AS margin_pct,
        {_safe('shipping_cost', 'CAST(orders AS DOUBLE)')} AS shipping_per_order,
        {_safe('shipping_cost', 'sales', ' * 100')} AS shipping_sales_pct
      FROM (SELECT {_zero('sales')} AS sales, {_zero('profit')} AS profit, {_zero('shipping_cost')} AS shipping_cost,
        CAST(COALESCE(SUM(quantity), 0) AS BIGINT) AS units, COUNT(*) AS line_items,
        COUNT(DISTINCT order_id_raw) AS orders FROM fact WHERE country = '{country}' AND {_window(window)})"""


def _country_shipmode(window: str) -> str:
    return f"""SELECT ship_mode, COALESCE(orders, 0) AS orders, COALESCE(sales, 0.0) AS sales,
        COALESCE(shipping, 0.0) AS shipping,
        CASE WHEN whole > 0 THEN {dbl('COALESCE(orders, 0)')} / {dbl('whole')} * 100 ELSE 0.0 END AS order_share_pct
      FROM (VALUES ('Standard Class'), ('Second Class'), ('First Class'), ('Same Day')) AS m(ship_mode)
      LEFT JOIN (SELECT ship_mode, COUNT(DISTINCT order_id_raw) AS orders, {_zero('sales')} AS sales,
                        {_zero('shipping_cost')} AS shipping
                 FROM fact WHERE country = 'NATION_2' AND {_window(window)} GROUP BY ship_mode) USING (ship_mode)
      CROSS JOIN (SELECT COUNT(DISTINCT order_id_raw) AS whole FROM fact WHERE country = 'NATION_2' AND {_window(window)})"""


# --- Features -------------------------------------------------------------

BRANDS = [f"Brand#{n}" for n in range(1, 26)]
REGIONS = [f"{r}-{k}" for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST") for k in (0, 1)]
# The levels found in the tables, the base level not dropped yet.
LEVELS = {
    "ship_mode": ["First Class", "Second Class", "Standard Class"],
    "order_priority": ["Critical", "High", "Low", "Medium"],
    "segment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "market": ["APAC", "Africa", "EMEA", "EU", "LATAM"],
    "region": sorted(REGIONS),
    "category": ["Furniture", "Office Supplies", "Technology"],
    "sub_category": sorted(BRANDS),
}
NUMERIC = (
    "sales", "discount", "quantity", "shipping_cost", "shipping_cost_ratio", "discount_impact", "total_cost_spent",
)


def _features(discount: str, total: str, ratio: str = "CASE WHEN s > 0 THEN f / s ELSE 0.0 END", more: str = "") -> str:
    inner = f"""SELECT *, {dbl('sales')} AS s, {discount} AS d, {dbl('quantity')} AS q, {dbl('shipping_cost')} AS f FROM fact"""
    return f"""SELECT s AS sales, d AS discount, q AS quantity, f AS shipping_cost, {ratio} AS shipping_cost_ratio,
        s * d AS discount_impact, {total} AS total_cost_spent{more}
        FROM (SELECT order_priority, s, d, q, f FROM ({inner}))"""


PRIORITY_LABEL = (
    ", CASE order_priority WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Low' THEN 2 WHEN 'Medium' THEN 3 END AS label"
)
# Discount as it comes in a record: percent, as a double.
PCT = dbl("discount * 100")
PROFIT_FEATURES = _features(f"{PCT} / CAST(100 AS DOUBLE)", "f + s * d")
FRACTION = f"{PCT} / CAST(100 AS DOUBLE)"
TRAINING_FEATURES = _features(FRACTION, "s + f", "COALESCE(f / NULLIF(s, 0), 0.0)")
_MIXED = f"CASE WHEN quantity % 2 = 1 THEN {PCT} ELSE {FRACTION} END"
PRIORITY_FEATURES = _features(f"CASE WHEN {_MIXED} > 1.0 THEN {_MIXED} / CAST(100 AS DOUBLE) ELSE {_MIXED} END", "s + f")
TRIAGE_FEATURES = _features(f"CASE WHEN {FRACTION} > 1.0 THEN {FRACTION} / CAST(100 AS DOUBLE) ELSE {FRACTION} END", "s + f")

_VOCABULARY = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c} AS level FROM fact GROUP BY {c} HAVING {c} > (SELECT min({c}) FROM fact)" for c in LEVELS
)
_ONEHOT = ", ".join(
    f"""CAST(CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS DOUBLE) AS "{c}_{v}\""""
    for c, vs in LEVELS.items()
    for v in vs[1:]
)
_SCALER = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std FROM tf" for c in NUMERIC
)
_SCALED = (
    "SELECT "
    + ", ".join(f"round(({c} - m_{c}) / CASE WHEN d_{c} = 0 THEN 1 ELSE d_{c} END, 4) AS {c}" for c in NUMERIC)
    + " FROM tf CROSS JOIN (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}" for c in NUMERIC)
    + " FROM tf)"
)

_FLAWED = f"""flawed AS (SELECT {dbl('sales')} - 2000 AS sales, {PCT} * 12 - 6 AS discount, quantity - 3 AS quantity,
    {dbl('shipping_cost')} - 100 AS shipping_cost, CASE WHEN segment <> 'MACHINERY' THEN segment END AS segment FROM fact),
judged AS (SELECT list_filter([
    CASE WHEN sales <= 0 THEN 'sales_not_positive' END,
    CASE WHEN discount < 0 OR discount > 100 THEN 'discount_out_of_range' END,
    CASE WHEN quantity < 1 THEN 'quantity_below_one' END,
    CASE WHEN shipping_cost < 0 THEN 'shipping_cost_negative' END,
    CASE WHEN segment IS NULL THEN 'missing_segment' END], lambda x: x IS NOT NULL) AS reasons FROM flawed)"""

# --- Decoders -------------------------------------------------------------

_WEIGHTS = {i: f"CAST(1 + (quantity * {k} + pct) % {m} AS DOUBLE)" for i, (k, m) in enumerate([(3, 7), (5, 11), (7, 13), (2, 5)])}
_STAND_IN = f"""base AS (SELECT *, CAST(ROUND(discount * 100) AS INTEGER) AS pct FROM fact),
stand_in AS (SELECT *, CAST((quantity * 37 + pct * 113) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS p1,
    {', '.join(f'{w} AS w{i}' for i, w in _WEIGHTS.items())}, (quantity + pct) % 5 AS guess4 FROM base),
probs AS (SELECT *, CAST(1 AS DOUBLE) - p1 AS p0, p1 >= 0.5 AS hit,
    {', '.join(f'w{i} / (w0 + w1 + w2 + w3) AS q{i}' for i in range(4))},
    (quantity * 7 + pct) % 4 AS rule4,
    CASE order_priority WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Low' THEN 2 WHEN 'Medium' THEN 3 END AS truth4
  FROM stand_in)"""


def pct(x: str) -> str:
    return half_up(f"({x}) * 100", 1)


_STATUS = "CASE WHEN profit > 0 THEN 'PROFIT' WHEN profit = 0 THEN 'BREAK EVEN' ELSE 'LOSS' END"
_DECODE_PROFIT = f"""SELECT CASE WHEN hit THEN 'PROFIT' ELSE 'LOSS' END AS prediction, hit AS is_profit,
    {pct('greatest(p0, p1)')} AS confidence, {pct('p1')} AS profit_probability,
    {half_up(f"100 - {pct('p1')}", 1)} AS loss_probability FROM probs"""
_DECODE_AMOUNT = f"""SELECT {half_up(dbl('profit'), 2)} AS estimated_profit, profit > 0 AS is_profitable,
    profit = 0 AS is_break_even, {_STATUS} AS net_status FROM fact"""
_RULE = f"""SELECT {_STATUS} AS prediction, profit > 0 AS is_profit, {dbl('100')} AS confidence, true AS rule_derived,
    CASE WHEN profit > 0 THEN {dbl('100')} ELSE {dbl('0')} END AS profit_probability,
    CASE WHEN profit > 0 THEN {dbl('0')} ELSE {dbl('100')} END AS loss_probability FROM fact"""
_DECODE2 = f"""SELECT CAST(hit AS INTEGER) AS prediction, hit AS is_urgent,
    CASE WHEN hit THEN 'Urgent' ELSE 'Normal' END AS priority_label, CASE WHEN hit THEN 'urgent' ELSE 'normal' END AS urgency,
    CASE WHEN hit THEN '{URGENT_MESSAGE}' ELSE '{NORMAL_MESSAGE}' END AS message,
    {pct('greatest(p0, p1)')} AS confidence, {pct('p1')} AS urgent_probability, {pct('p0')} AS normal_probability,
    {pct('p1')} AS priority_score, {pct('p1')} AS prob_urgent, {pct('p0')} AS prob_normal,
    {half_up(f"{pct('p1')} * CAST(0.4 AS DOUBLE)", 1)} AS prob_critical, {half_up(f"{pct('p1')} * CAST(0.6 AS DOUBLE)", 1)} AS prob_high,
    {half_up(f"{pct('p0')} * CAST(0.6 AS DOUBLE)", 1)} AS prob_medium, {half_up(f"{pct('p0')} * CAST(0.4 AS DOUBLE)", 1)} AS prob_low FROM probs"""
_URGENT4 = pct(f"{dbl('0')} + q0 + q1")
_NORMAL4 = half_up(f"100 - {_URGENT4}", 1)
_DECODE4 = f"""SELECT CAST(guess4 AS INTEGER) AS prediction, guess4 IN (0, 1) AS is_urgent,
    CASE guess4 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' WHEN 2 THEN 'Low' WHEN 3 THEN 'Medium' ELSE 'Class ' || guess4 END AS priority_label,
    CASE guess4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'low' ELSE 'medium' END AS urgency,
    CASE guess4 WHEN 0 THEN '{PRIORITY_MESSAGES['Critical']}' WHEN 1 THEN '{PRIORITY_MESSAGES['High']}'
      WHEN 2 THEN '{PRIORITY_MESSAGES['Low']}' WHEN 3 THEN '{PRIORITY_MESSAGES['Medium']}' ELSE '' END AS message,
    {pct('greatest(q0, q1, q2, q3)')} AS confidence, {_URGENT4} AS urgent_probability, {_NORMAL4} AS normal_probability,
    {_URGENT4} AS priority_score, {_URGENT4} AS prob_urgent, {_NORMAL4} AS prob_normal, {pct('q0')} AS prob_critical,
    {pct('q1')} AS prob_high, {pct('q3')} AS prob_medium, {pct('q2')} AS prob_low FROM probs"""


def _counted(body: str) -> str:
    return f"SELECT *, COUNT(*) AS line_count FROM ({body}) GROUP BY ALL"


_REPORT = """cells AS (SELECT truth4 AS t, rule4 AS g, COUNT(*) AS n FROM probs GROUP BY ALL),
classes AS (SELECT DISTINCT t AS c FROM cells UNION SELECT DISTINCT g FROM cells),
sums AS (SELECT c, COALESCE((SELECT SUM(n) FROM cells WHERE t = c), 0) AS support,
    COALESCE((SELECT SUM(n) FROM cells WHERE g = c), 0) AS guessed,
    COALESCE((SELECT SUM(n) FROM cells WHERE t = c AND g = c), 0) AS hits FROM classes),
pr AS (SELECT *, COALESCE(CAST(hits AS DOUBLE) / NULLIF(guessed, 0), 0.0) AS p,
    COALESCE(CAST(hits AS DOUBLE) / NULLIF(support, 0), 0.0) AS r FROM sums),
prf AS (SELECT *, COALESCE(2 * p * r / NULLIF(p + r, 0), 0.0) AS f FROM pr)"""
_REPORT_ROWS = """SELECT CAST(c AS VARCHAR) AS class, round(p, 6) AS "precision", round(r, 6) AS recall,
    round(f, 6) AS f1_score, CAST(support AS BIGINT) AS support FROM prf
  UNION ALL SELECT 'accuracy', NULL, NULL, round(CAST(SUM(hits) AS DOUBLE) / SUM(support), 6), CAST(SUM(support) AS BIGINT) FROM prf
  UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(SUM(support) AS BIGINT) FROM prf
  UNION ALL SELECT 'weighted avg', round(SUM(p * support) / SUM(support), 6), round(SUM(r * support) / SUM(support), 6),
    round(SUM(f * support) / SUM(support), 6), CAST(SUM(support) AS BIGINT) FROM prf"""


_PRIORITY_CHECKS = ("probabilities in range", "probabilities add up", "class is the likeliest", "sides add up", "every class has a share")
CHECKS = {
    "score_classify_checks": (
        "probabilities in range", "probabilities add up", "class is the likelier", "confidence is the larger", "class named",
    ),
    "score_regress_checks": ("estimate is a number", "status follows the sign", "one of the flags", "margin is a share of sales"),
    "score_priority_binary_checks": _PRIORITY_CHECKS,
    "score_priority_4class_checks": _PRIORITY_CHECKS,
}


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name, body in _rollups("").items():
        out[name] = _sql(body)
    for name, body in _rollups(FILTER).items():
        out[f"{name}_filtered"] = _sql(body)
    out["stored_star_kpi"] = out["kpi_filtered"]

    out["line_fact"] = _sql(
        f"""SELECT row_id, order_key, order_id_raw, customer_id, location_id, {day('order_date')} AS order_date,
        {day('ship_date')} AS ship_date, ship_mode, order_priority, customer_name, segment, product_id, product_name,
        category, sub_category, city, state, country, region, market, {dbl('sales')} AS sales, {dbl('profit')} AS profit,
        {dbl('shipping_cost')} AS shipping_cost, {dbl('discount')} AS discount, quantity, year, week_num FROM fact"""
    )
    out["orders_by_shipmode"] = _sql(SHIPMODE)
    out["orders_by_priority"] = _sql(
        f"""SELECT order_priority, {ORDERS} AS order_count, {cents('SUM(sales)')} AS total_sales,
        {half_up(f'AVG({DAYS})', 1)} AS avg_shipping_days FROM fact GROUP BY order_priority"""
    )
    two = f"{cents('SUM(sales)')} AS sales, {cents('SUM(profit)')} AS profit"
    out["weekly_trend"] = _sql(
        f"SELECT year, week_num, {two} FROM s_items GROUP BY year, week_num ORDER BY year, week_num LIMIT 200"
    )
    out["profit_margin_trend"] = _sql(
        f"""SELECT year, {two}, {half_up(f"{dbl('SUM(profit)')} / NULLIF({dbl('SUM(sales)')}, 0) * 100", 2)} AS margin_pct
        FROM s_items GROUP BY year"""
    )
    out["monthly_sales_trend"] = _sql(
        f"SELECT strftime(order_date, '%Y-%m') AS month, {two}, COUNT(*) AS line_count FROM fact GROUP BY ALL"
    )
    out["profit_histogram"] = _sql(
        f"""SELECT floor({dbl('profit')} / CAST(5000 AS DOUBLE)) * CAST(5000 AS DOUBLE) AS bucket_start,
        COUNT(*) AS line_count FROM fact GROUP BY ALL"""
    )
    out["profit_vs_discount"] = _sql(
        f"""SELECT {dbl('discount')} AS discount, COUNT(*) AS line_count, {mean('profit', 2)} AS avg_profit,
        {half_up(f"{dbl('COUNT(*) FILTER (profit < 0)')} / COUNT(*) * 100", 1)} AS loss_share_pct FROM fact GROUP BY ALL"""
    )
    out["profit_badge_counts"] = _sql(
        f"""SELECT CASE WHEN profit IS NULL THEN 'muted' WHEN ROUND(profit, 2) >= 0 THEN 'success' ELSE 'danger' END AS level,
        COUNT(*) AS line_count, {cents('SUM(profit)')} AS profit FROM fact GROUP BY level"""
    )
    out["net_status_counts"] = _sql(f"SELECT {_STATUS} AS net_status, COUNT(*) AS line_count FROM fact GROUP BY 1")
    out["badge_level_counts"] = _sql(
        """SELECT 'segment' AS kind, segment AS value, CASE segment WHEN 'Consumer' THEN 'info' WHEN 'Corporate' THEN 'purple'
             WHEN 'Home Office' THEN 'cyan' ELSE 'muted' END AS level, COUNT(*) AS order_count
           FROM s_orders JOIN s_customers USING (customer_id) GROUP BY ALL
           UNION ALL SELECT 'order_priority', order_priority, CASE order_priority WHEN 'Critical' THEN 'danger'
             WHEN 'High' THEN 'warning' WHEN 'Medium' THEN 'info' ELSE 'muted' END, COUNT(*) FROM s_orders GROUP BY ALL
           UNION ALL SELECT 'ship_mode', ship_mode, CASE ship_mode WHEN 'Same Day' THEN 'danger' WHEN 'First Class' THEN 'warning'
             WHEN 'Second Class' THEN 'info' ELSE 'muted' END, COUNT(*) FROM s_orders GROUP BY ALL"""
    )
    out["margin_metrics"] = _sql(
        f"""SELECT sub_category, COUNT(*) AS line_count, round(min(m), 4) AS min_margin_pct, round(max(m), 4) AS max_margin_pct,
        {half_up('avg(least(abs(m), 100))', 4)} AS avg_bar_width, {half_up('sum(impact)', 4)} AS discount_impact
        FROM (SELECT sub_category, CASE WHEN sales > 0 THEN {dbl('profit')} / {dbl('sales')} * 100 ELSE 0.0 END AS m,
              {dbl('sales')} * ({dbl('discount')} * 100) / CAST(100 AS DOUBLE) AS impact FROM fact) GROUP BY sub_category"""
    )

    for name, body in DRILL.items():
        out[name] = _sql(body)
    out["drill_countries_top1"] = _sql(DRILL["drill_countries"].replace("LIMIT 8", "LIMIT 1"))
    out["segment_share"] = _sql(SHARE)
    out["dashboard_summary"] = _sql(_dashboard())
    out["region_drilldown"] = _sql(_drilldown())

    plain = _rollups("")
    out["kpi_formatted"] = _sql(
        f"""SELECT {compact('total_revenue')} AS revenue_text, {compact('total_profit')} AS profit_text,
        {compact('total_shipping_cost')} AS shipping_text, {compact('avg_order_value')} AS order_value_text,
        format('{{:,}}', total_orders) AS orders_text, format('{{:,}}', total_items) AS items_text,
        {text('avg_discount_pct', 1)} || '%' AS discount_text FROM ({plain['kpi']})"""
    )
    out["avg_price_top"] = _sql(
        f"""SELECT sub_category, avg_unit_price FROM ({plain['quantity_stats']})
        ORDER BY avg_unit_price DESC NULLS LAST, sub_category LIMIT 8"""
    )
    out["quantity_bubble"] = _sql(
        f"""SELECT sub_category, quantity AS x, revenue AS y,
        {half_up('greatest(CAST(5 AS DOUBLE), sqrt(avg_unit_price) * CAST(1.2 AS DOUBLE))', 4)} AS radius, profit
        FROM ({plain['quantity_stats']})"""
    )
    for label, source in (("sub_category", "top_subcategory"), ("region", "region_stats"), ("segment", "segment_stats")):
        key = f"{label.replace('_', '')}_by_quantity"
        out[key] = _sql(f"SELECT {label}, quantity AS value FROM ({plain[source]})")

    # Listings
    out["orders_listing"] = _sql(LISTING)
    out["orders_search"] = _sql(f"{LISTING} WHERE {_like('brand#1', *_ORDER_TEXT)}")
    out["orders_explorer"] = _sql(f"{LISTING} {FILTER} AND {_like('wid_et%', *_ORDER_TEXT)}")
    out["orders_page"] = _sql(_orders_page("", 0, 20))
    out["orders_page_search"] = _sql(_orders_page(f"WHERE {_like('brand#1', *_ORDER_TEXT)}", 40, 20))
    out["orders_page_filtered"] = _sql(_orders_page(FILTER, 50, 50))
    out["orders_far_page"] = _sql(_orders_page("", 3000, 50))
    products_order = "ORDER BY total_profit DESC NULLS LAST, product_id LIMIT 20 OFFSET 20"
    for name in ("products_rollup", "join_left_products"):
        out[name] = _sql(_products())
    for name in ("products_page", "products_keyset_page"):
        out[name] = _sql(f"{_products()} {products_order}")
    for name, body in (("customers", _customers()), ("locations", _locations())):
        out[f"{name}_rollup"] = out[f"join_left_{name}"] = _sql(body)
        key = name[:-1] + "_id"
        out[f"{name}_page"] = _sql(f"{body} ORDER BY total_sales DESC NULLS LAST, {key} LIMIT 20 OFFSET 20")
    out["products_search"] = _sql(_products(f"WHERE {_like('RED', 'product_name', 'category', 'sub_category')}"))
    out["customers_search"] = _sql(_customers(f"WHERE {_like('furni', 'customer_name', 'segment')}"))
    out["locations_search"] = _sql(_locations(f"WHERE {_like('asia-1', 'city', 'country', 'region', 'market')}"))
    out["pagination_counts"] = _sql(_totals(None))
    out["pagination_counts_search"] = _sql(_totals("brand#1"))
    out["page_info"] = _sql(
        f"""SELECT listing, total, 2 AS page, 20 AS page_size, CAST(ceil(total / 20.0) AS BIGINT) AS page_count,
        CAST(20 AS BIGINT) AS row_offset, CAST(21 AS BIGINT) AS first_row, least(CAST(40 AS BIGINT), total) AS last_row
        FROM ({_totals(None)})"""
    )
    out["customer_texts"] = _sql(
        f"""SELECT customer_id, format('{{:,}}', total_orders) AS orders_text, {compact('total_sales')} AS sales_text,
        CASE WHEN total_profit IS NULL THEN '—' ELSE CASE WHEN total_profit >= 0 THEN '+' ELSE '' END || '$' ||
          {text('abs(total_profit)', 2)} END AS profit_text,
        CASE WHEN total_profit IS NULL THEN 'muted' WHEN total_profit >= 0 THEN 'success' ELSE 'danger' END AS profit_level,
        COALESCE({text('avg_discount', 1)} || '%', '—') AS discount_text FROM ({_customers()})"""
    )
    out["order_date_texts"] = _sql(
        f"""SELECT {day('order_date')} AS order_day, COALESCE({day('ship_date')}, '—') AS ship_day, COUNT(*) AS order_count
        FROM s_orders GROUP BY ALL"""
    )
    out["export_csv"] = out["customers_rollup"]

    # Geography
    out["country_catalog"] = _sql(
        """SELECT country, min(region) AS region, min(market) AS market, COUNT(DISTINCT order_id_raw) AS orders,
        COUNT(DISTINCT city) AS cities FROM s_orders JOIN s_locations USING (location_id) GROUP BY country"""
    )
    out["market_countries"] = _sql(
        """SELECT market, CAST(row_number() OVER (PARTITION BY market ORDER BY country) - 1 AS INTEGER) AS position, country
        FROM (SELECT DISTINCT market, country FROM s_locations)"""
    )
    out["category_hierarchy"] = _sql(
        """SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY sub_category) - 1 AS INTEGER) AS position,
        sub_category FROM (SELECT DISTINCT category, sub_category FROM s_products)"""
    )
    out["country_highlight"] = _sql(
        """SELECT country, min(region) AS region, min(market) AS market,
        CASE WHEN min(market) = 'APAC' THEN 'matched' ELSE 'dimmed' END AS state
        FROM s_orders JOIN s_locations USING (location_id) GROUP BY country"""
    )
    out["country_lines"] = _sql(
        f"""SELECT order_id_raw, {day('order_date')} AS order_date, ship_mode, {cents('sales')} AS sales,
        {cents('profit')} AS profit, {cents('shipping_cost')} AS shipping_cost, quantity FROM fact WHERE country = 'NATION_2'"""
    )
    for name, country, window in (
        ("country_stats", "NATION_2", "all"),
        ("country_day_stats", "NATION_2", "day"),
        ("country_q4_stats", "NATION_2", "q4"),
        ("country_empty_stats", "NOWHERE", "all"),
    ):
        out[name] = _sql(_country_stats(country, window))
    out["country_shipmode"] = _sql(_country_shipmode("all"))
    out["country_shipmode_q4"] = _sql(_country_shipmode("q4"))
    clamp = "greatest(DATE '1996-01-01', least(DATE '1998-12-31', d {0} INTERVAL 7 DAY))"
    out["step_day"] = _sql(
        f"""SELECT {day('d')} AS day, {day(clamp.format('-'))} AS previous_day, {day(clamp.format('+'))} AS next_day
        FROM (SELECT DISTINCT CAST(order_date AS DATE) AS d FROM s_orders)"""
    )

    # Transactions, features, labels
    out["read_transactions"] = _sql(
        f"""SELECT segment, ship_mode, COUNT(*) AS record_count, CAST(SUM(quantity) AS BIGINT) AS quantity,
        {half_up(dbl('SUM(sales)'), 2)} AS sales, {half_up(f'AVG({PCT})', 4)} AS avg_discount FROM fact GROUP BY ALL"""
    )
    out["features_profit"] = _sql(PROFIT_FEATURES)
    out["features_priority"] = _sql(PRIORITY_FEATURES)
    out["features_training"] = _sql(TRAINING_FEATURES)
    out["triage_training_features"] = _sql(_features(FRACTION, "s + f", "COALESCE(f / NULLIF(s, 0), 0.0)", PRIORITY_LABEL))
    out["onehot_vocab"] = _sql(_VOCABULARY)
    out["onehot_features"] = _sql(f"SELECT {_ONEHOT} FROM fact")
    out["scaler_stats"] = _sql(_SCALER, f"tf AS ({TRAINING_FEATURES})")
    out["features_scaled"] = _sql(_SCALED, f"tf AS ({TRAINING_FEATURES})")
    out["label_urgent"] = _sql(
        "SELECT CASE WHEN order_priority IN ('Critical', 'High') THEN 1 ELSE 0 END AS urgent, COUNT(*) AS line_count FROM fact GROUP BY 1"
    )
    out["label_priority4"] = _sql(
        """SELECT CASE order_priority WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Low' THEN 2 WHEN 'Medium' THEN 3 END
        AS priority_index, COUNT(*) AS line_count FROM fact GROUP BY 1"""
    )
    out["label_profit"] = _sql(
        "SELECT CASE WHEN profit > 0 THEN 1 ELSE 0 END AS profitable, COUNT(*) AS line_count FROM fact GROUP BY 1"
    )
    out["class_weights"] = _sql(
        f"""SELECT order_priority, n AS line_count, {dbl('SUM(n) OVER ()')} / {dbl('COUNT(*) OVER () * n')} AS weight
        FROM (SELECT order_priority, COUNT(*) AS n FROM fact GROUP BY 1)"""
    )
    out["validation_report"] = _sql(
        """SELECT outcome, COUNT(*) AS record_count FROM (SELECT unnest(CASE WHEN len(reasons) = 0 THEN ['valid'] ELSE reasons END)
        AS outcome FROM judged) GROUP BY outcome""",
        _FLAWED,
    )
    out["score_stream"] = _sql(
        """SELECT outcome, COUNT(*) AS record_count FROM (SELECT unnest(CASE WHEN len(reasons) = 0 THEN ['scored'] ELSE reasons END)
        AS outcome FROM judged) GROUP BY outcome""",
        _FLAWED,
    )
    out["save_load_model"] = _sql("SELECT true AS same_result, COUNT(*) AS line_count FROM fact")
    out["validation_split"] = _sql(
        "SELECT array_to_string(reasons, ',') AS reasons, COUNT(*) AS record_count FROM judged GROUP BY 1", _FLAWED
    )

    out["bucketed_star_region_stats"] = out["region_stats_filtered"]
    # Every line fulfils every check of its scores
    for name, checks in CHECKS.items():
        rows = " UNION ALL ".join(f"SELECT '{c}' AS \"check\", COUNT(*) AS line_count FROM fact" for c in checks)
        out[name] = _sql(rows)
    inputs = "sales, discount, quantity, shipping_cost, ship_mode, order_priority, segment, market, region, category, sub_category"
    out["what_if_best_checks"] = _sql(
        f"""SELECT COUNT(*) AS different, CAST(SUM(n) AS BIGINT) AS line_count
        FROM (SELECT {inputs}, COUNT(*) AS n FROM fact GROUP BY ALL)"""
    )

    # Decoders, what-if, evaluation
    out["decode_profit"] = _sql(_counted(_DECODE_PROFIT), _STAND_IN)
    out["decode_amount"] = _sql(_counted(_DECODE_AMOUNT))
    out["rule_derived_class"] = _sql(_counted(_RULE))
    out["decode_priority2"] = _sql(_counted(_DECODE2), _STAND_IN)
    out["decode_priority4"] = _sql(_counted(_DECODE4), _STAND_IN)
    out["features_used"] = _sql(
        f"""SELECT sales, {half_up('discount * 100', 2)} AS discount, CAST(quantity AS INTEGER) AS quantity, shipping_cost,
        {half_up('shipping_cost_ratio', 4)} AS shipping_cost_ratio, {half_up('discount_impact', 2)} AS discount_impact,
        {half_up('total_cost_spent', 2)} AS total_cost_spent FROM ({TRIAGE_FEATURES})"""
    )
    out["what_if_grid"] = _sql(
        f"""SELECT discount_pct, COUNT(*) AS row_count, {half_up('avg(s * (discount_pct / CAST(100 AS DOUBLE)))', 4)} AS avg_discount_impact,
        {half_up('avg(f + s * (discount_pct / CAST(100 AS DOUBLE)))', 4)} AS avg_total_cost
        FROM (SELECT {dbl('sales')} AS s, {dbl('shipping_cost')} AS f FROM fact),
             (SELECT CAST(range AS INTEGER) AS discount_pct FROM range(0, 101)) GROUP BY discount_pct"""
    )
    out["classification_report"] = _sql(_REPORT_ROWS, _STAND_IN, _REPORT)
    out["prediction_counts"] = _sql("SELECT rule4, COUNT(*) AS line_count FROM probs GROUP BY rule4", _STAND_IN)
    out["confusion_crosstab"] = _sql(
        "SELECT order_priority, "
        + ", ".join(f"COUNT(*) FILTER (guess4 = {i}) AS pred_{i}" for i in range(6))
        + " FROM probs GROUP BY order_priority",
        _STAND_IN,
    )
    out["mean_prob_by_class"] = _sql(
        "SELECT order_priority, " + ", ".join(f"round(avg(q{i}), 6) AS prob_{i}" for i in range(4)) + " FROM probs GROUP BY 1",
        _STAND_IN,
    )
    return out
