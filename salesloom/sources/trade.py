"""Star schema over wholesale trade tables (orders, line items, parts, ...).

Every column is stated as an expression, and the joins that profit, ship date
and location need happen only when a query asks for those columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom.functions.numeric import FRACTION, MONEY
from salesloom.sources.star import AMOUNTS, Derived, Star

# How trade codes map to the retail vocabulary.
SHIP_MODES = {"F": "Standard Class", "O": "Second Class", "P": "First Class"}
PRIORITIES = {"1-URGENT": "Critical", "2-HIGH": "High", "5-LOW": "Low"}
CATEGORIES = {0: "Furniture", 1: "Office Supplies", 2: "Technology"}
MARKETS = {
    "AFRICA": "Africa",
    "AMERICA": "LATAM",
    "ASIA": "APAC",
    "EUROPE": "EU",
    "MIDDLE EAST": "EMEA",
}
CITIES_PER_NATION = 4

# Declared, so that opening the tables starts no job to look at file footers.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_shipdate timestamp_ntz"
    ),
}


def _mapped(source, mapping: dict, default=None):
    items = list(mapping.items())
    chain = F.when(source == items[0][0], items[0][1])
    for key, value in items[1:]:
        chain = chain.when(source == key, value)
    return chain if default is None else chain.otherwise(default)


def hundredths(column) -> Column:
    """A two-decimal double as a whole number of hundredths, exactly."""
    value = F.col(column) if isinstance(column, str) else column
    return F.rint(value * F.lit(100.0)).cast("bigint")


def _from_units(name: str) -> Derived:
    """The decimal amount of a whole-number column in ten-thousandths."""
    units = f"{name}_units"
    kind = FRACTION if name == "discount" else MONEY
    return Derived((units,), (F.col(units).cast("decimal(13,0)") * F.lit("0.0001").cast("decimal(4,4)")).cast(kind))


def _items(line: DataFrame) -> DataFrame:
    """Lines with amounts in ten-thousandths.

    Whole numbers keep per-line arithmetic in generated code; casting doubles
    to decimal by way of their digits costs several times as much.
    """
    price = hundredths("l_extendedprice")
    return line.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        price.alias("price_cents"),
        hundredths("l_discount").alias("discount_percent"),
        (price * 100).alias("sales_units"),
        (price * hundredths("l_tax")).alias("shipping_cost_units"),
        (hundredths("l_discount") * 100).alias("discount_units"),
        F.col("l_shipdate").alias("line_ship_date"),
    )


def _orders(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").alias("order_key"),
        F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("order_id_raw"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("order_date"),
        _mapped(F.col("o_orderstatus"), SHIP_MODES).alias("ship_mode"),
        _mapped(F.col("o_orderpriority"), PRIORITIES, "Medium").alias("order_priority"),
    )


def _ship_dates(line: DataFrame) -> DataFrame:
    return line.groupBy(F.col("l_orderkey").alias("order_key")).agg(F.max("l_shipdate").alias("ship_date"))


def _customers(customer: DataFrame) -> DataFrame:
    return customer.select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").alias("nation_key"),
    )


def _products(part: DataFrame) -> DataFrame:
    brand_number = F.substring("p_brand", 7, 10).cast("int")
    return part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        _mapped(brand_number % 3, CATEGORIES).alias("category"),
        F.col("p_brand").alias("sub_category"),
        hundredths("p_retailprice").alias("list_cents"),
    )


def _locations(nation: DataFrame, region: DataFrame) -> DataFrame:
    places = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).withColumn(
        "k", F.explode(F.sequence(F.lit(0), F.lit(CITIES_PER_NATION - 1)))
    )
    return places.select(
        (F.col("n_nationkey") * CITIES_PER_NATION + F.col("k")).cast("bigint").alias("location_id"),
        F.concat("n_name", F.lit("-C"), F.col("k").cast("string")).alias("city"),
        F.lit(None).cast("string").alias("state"),
        F.col("n_name").alias("country"),
        F.concat("r_name", F.lit("-"), (F.col("n_nationkey") % 2).cast("string")).alias("region"),
        _mapped(F.col("r_name"), MARKETS).alias("market"),
    )


def trade_star(spark: SparkSession, path: str) -> Star:
    """The star over ``path/{lineitem,orders,customer,part,nation,region}.parquet``."""

    def read(name: str) -> DataFrame:
        return spark.read.schema(TABLES[name]).parquet(f"{path}/{name}.parquet")

    line = read("lineitem")
    tables = {
        "order_items": _items(line),
        "orders": _orders(read("orders")),
        "dim_customers": _customers(read("customer")),
        "dim_products": _products(read("part")),
        "dim_locations": _locations(read("nation"), read("region")),
    }
    # sales * (1 - discount) - quantity * list price, in ten-thousandths.
    gross = F.col("price_cents") * (F.lit(100) - F.col("discount_percent"))
    cost = F.col("quantity") * F.col("list_cents") * 100
    home = F.col("nation_key") * CITIES_PER_NATION + F.col("customer_id") % CITIES_PER_NATION
    return Star(
        tables,
        derived={
            "profit_units": Derived(("price_cents", "discount_percent", "quantity", "list_cents"), gross - cost),
            **{name: _from_units(name) for name in AMOUNTS},
            "year": Derived(("order_date",), F.year("order_date")),
            "week_num": Derived(("order_date",), F.weekofyear("order_date")),
            "location_id": Derived(("customer_id", "nation_key"), home.cast("bigint")),
        },
        header_lookups={"ship_date": _ship_dates(line)},
        line_extremes={"ship_date": "line_ship_date"},
        origin=path,
    )
