"""The star schema: one line table, order headers and three dimensions.

Keys are primary keys: ``order_key`` is unique in ``orders`` and each dimension
key in its dimension. ``row_id`` is only ever counted and need not be unique.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom.functions.numeric import FRACTION, MONEY

# Column -> type it is read as; None keeps the stored type (keys of any kind).
SCHEMA: dict[str, dict[str, object]] = {
    "order_items": {
        "row_id": None,
        "order_key": None,
        "product_id": None,
        "sales": MONEY,
        "profit": MONEY,
        "shipping_cost": MONEY,
        "discount": FRACTION,
        "quantity": "int",
        "year": "int",
        "week_num": "int",
    },
    "orders": {
        "order_key": None,
        "order_id_raw": "string",
        "customer_id": None,
        "location_id": None,
        "order_date": "timestamp_ntz",
        "ship_date": "timestamp_ntz",
        "ship_mode": "string",
        "order_priority": "string",
    },
    "dim_customers": {"customer_id": None, "customer_name": "string", "segment": "string"},
    "dim_products": {
        "product_id": None,
        "product_name": "string",
        "category": "string",
        "sub_category": "string",
    },
    "dim_locations": {
        "location_id": None,
        "city": "string",
        "state": "string",
        "country": "string",
        "region": "string",
        "market": "string",
    },
}

ITEM_COLUMNS = tuple(SCHEMA["order_items"])
ORDER_COLUMNS = tuple(SCHEMA["orders"])
CUSTOMER_COLUMNS = tuple(SCHEMA["dim_customers"])
PRODUCT_COLUMNS = tuple(SCHEMA["dim_products"])
LOCATION_COLUMNS = tuple(SCHEMA["dim_locations"])


# Amounts with a whole-number twin ``<name>_units`` in ten-thousandths, which
# is what sums are made of.
AMOUNTS = ("sales", "profit", "shipping_cost", "discount")
UNITS_PER_ONE = 10_000


@dataclass(frozen=True)
class Derived:
    """A column computed from others, possibly of a joined table."""

    inputs: tuple[str, ...]
    value: Column


def in_units(amount: str) -> Derived:
    return Derived((amount,), (F.col(amount) * F.lit(UNITS_PER_ONE)).cast("bigint"))


@dataclass
class Star:
    """Tables plus the columns that are computed instead of stored.

    ``derived`` lets a source state "profit needs the product's list price" once,
    so the join that brings the price is the same join that brings the category.
    A derived column may use those stated before it.
    ``header_lookups`` maps an order column to a frame keyed by ``order_key``
    that is joined only when the column is asked for. ``line_extremes`` maps an order
    column to the line column whose largest value per order it is, so that a sum of
    lines by order brings it along without that join. ``dated_lines`` states that the
    ``year`` of a line is that of its order's date.
    """

    tables: dict[str, DataFrame]
    derived: dict[str, Derived] = field(default_factory=dict)
    header_lookups: dict[str, DataFrame] = field(default_factory=dict)
    line_extremes: dict[str, str] = field(default_factory=dict)
    dated_lines: bool = False
    origin: str = ""

    def __post_init__(self):
        for amount in AMOUNTS:
            self.derived.setdefault(f"{amount}_units", in_units(amount))

    def closure(self, columns) -> set[str]:
        """The columns with the inputs of every derived one added."""
        wanted = set(columns)
        while True:
            extra = {i for c in wanted if c in self.derived for i in self.derived[c].inputs}
            if extra <= wanted:
                return wanted
            wanted |= extra

    def has(self, table: str, column: str) -> bool:
        return column in self.tables[table].columns

    def take(self, table: str, columns) -> DataFrame:
        frame = self.tables[table]
        return frame.select(*[c for c in frame.columns if c in set(columns)])


def conform(frame: DataFrame, table: str) -> DataFrame:
    """Pick a table's columns and read them with the schema's types."""
    return frame.select(
        *[
            (F.col(name) if kind is None else F.col(name).cast(kind)).alias(name)
            for name, kind in SCHEMA[table].items()
        ]
    )


def table_options(kind: str, table: str, options: dict, by_table: dict[str, dict] | None = None) -> dict:
    """Reader options of one table: the common ones, then its own."""
    given = {"csv": {"header": True}, "jdbc": {"dbtable": table}}.get(kind, {})
    return {**options, **given, **(by_table or {}).get(table, {})}


def load_star_tables(spark: SparkSession, prefix: str, dated_lines: bool = False) -> Star:
    """The five tables ``<prefix>_<table>`` of the catalog."""
    return Star({t: conform(spark.table(f"{prefix}_{t}"), t) for t in SCHEMA}, origin=prefix, dated_lines=dated_lines)


def load_star(
    spark: SparkSession, path: str, kind: str = "parquet", by_table: dict[str, dict] | None = None, dated_lines: bool = False, **options
) -> Star:
    """Read the five tables from ``path/<table>``; ``jdbc`` takes them by name.

    ``by_table`` holds options of single tables. A database reads a table in
    parallel when it is given a split: ``{"order_items": {"partitionColumn":
    "row_id", "lowerBound": 1, "upperBound": 10**9, "numPartitions": 200}}``.
    """
    tables = {}
    for table in SCHEMA:
        reader = spark.read.format(kind).options(**table_options(kind, table, options, by_table))
        loaded = reader.load() if kind == "jdbc" else reader.load(f"{path}/{table}")
        tables[table] = conform(loaded, table)
    return Star(tables, origin=path, dated_lines=dated_lines)


def star_of(**tables: DataFrame) -> Star:
    """A star over frames already in hand."""
    return Star({name: conform(tables[name], name) for name in SCHEMA})


def register_views(tables: dict[str, DataFrame]) -> None:
    for name, frame in tables.items():
        frame.createOrReplaceTempView(name)
