"""A hand-made star with what the test tables lack, as frames and in SQLite."""

from __future__ import annotations

import sqlite3

from salesloom.sources.star import star_of

ITEMS = [
    # row_id, order_key, product_id, sales, profit, shipping_cost, discount, quantity, year, week_num
    (1, 1, "p1", 100.0, 20.5, 10.0, 0.1, 2, 2014, 53),
    (2, 1, "p2", 50.25, -5.125, 4.4, 0.0, 4, 2014, 53),
    (3, 2, "p1", 80.0, 0.0, 8.0, 1.0, 1, 2014, 52),
    (4, 3, "p2", 0.0, -3.0, 2.0, 0.5, 3, 2014, 22),
    (5, 3, "p1", 60.0, 6.005, 3.333, 0.25, 0, 2014, 22),
    (6, 4, "p4", 999.99, 100.0, 50.0, 0.2, 7, 2013, 1),
    (None, 4, "p2", 10.0, 1.0, 1.0, 0.0, 1, 2013, 1),
    (8, 6, "p1", 70.0, 7.0, 7.0, 0.15, 1, 2012, 10),
    (9, 1, "p9", 33.0, 3.0, 3.0, 0.0, 3, 2014, 53),
    (10, 7, "p5", 1500.0, 250.0, 25.0, 0.05, 30, 2014, 53),
    (11, 99, "p1", 5.0, 1.0, 1.0, 0.0, 1, 2011, 5),
]
ORDERS = [
    # order_key, order_id_raw, customer_id, location_id, order_date, ship_date, ship_mode, order_priority
    (1, "A-1", "c1", 1, "2014-12-31 13:30:00", "2015-01-02 01:30:00", "Standard Class", "Critical"),
    (2, "A-1", "c1", 1, "2014-12-30", "2014-12-30", "First Class", "High"),
    (3, "B_2", "c2", None, "2014-06-01", None, "Drone", "Low"),
    (4, "C%3", "c3", 2, "2013-01-05", "2013-01-09", None, "Medium"),
    (5, "D-4", "c1", 3, "2014-01-01", "2014-01-04", "Same Day", "Low"),
    (6, "E\\5", "c3", 3, None, "2012-03-10", "Second Class", "Medium"),
    (7, "F'6", "c9", 2, "2014-12-31", "2015-01-05", "", "High"),
]
CUSTOMERS = [
    ("c1", "Ann O'Neil", "Consumer"),
    ("c2", "bob_smith", "Corporate"),
    ("c3", "Éva 100%", "Home Office"),
    ("c4", "No Orders", "Consumer"),
]
PRODUCTS = [
    ("p1", "Desk, large", "Furniture", "Tables"),
    ("p2", "Pen \"blue\"", "Office Supplies", "Art"),
    ("p3", "Never sold", "Technology", "Phones"),
    ("p4", "Phone", "Technology", "Phones"),
    ("p5", "Chair", "Furniture", "Chairs"),
]
LOCATIONS = [
    (1, "Oslo", None, "Norway", "North", "EU"),
    (2, "Perth", "WA", "Australia", "Oceania", "APAC"),
    (3, "Bergen", "Vestland", "Norway", "North", "EU"),
    (4, "Nowhere", None, "Chad", "Africa", "Africa"),
]

NAMES = {
    "order_items": (
        "row_id order_key product_id sales profit shipping_cost discount quantity year week_num",
        ITEMS,
        "bigint bigint string double double double double int int int",
    ),
    "orders": (
        "order_key order_id_raw customer_id location_id order_date ship_date ship_mode order_priority",
        ORDERS,
        "bigint string string bigint string string string string",
    ),
    "dim_customers": ("customer_id customer_name segment", CUSTOMERS, "string string string"),
    "dim_products": ("product_id product_name category sub_category", PRODUCTS, "string string string string"),
    "dim_locations": (
        "location_id city state country region market",
        LOCATIONS,
        "bigint string string string string string",
    ),
}


def edge_star(spark):
    frames = {}
    for table, (columns, rows, kinds) in NAMES.items():
        schema = ", ".join(f"{c} {k}" for c, k in zip(columns.split(), kinds.split()))
        frames[table] = spark.createDataFrame(rows, schema)
    return star_of(**frames)


def edge_database() -> sqlite3.Connection:
    db = sqlite3.connect(":memory:")
    db.row_factory = sqlite3.Row
    for table, (columns, rows, _) in NAMES.items():
        names = columns.split()
        db.execute(f"CREATE TABLE {table} ({', '.join(names)})")
        db.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(names))})", rows)
    return db
