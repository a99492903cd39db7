"""Transactions to score: declared schema, batch or stream, and from the star."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesloom.plans.fact import lines
from salesloom.plans.filters import NO_FILTER, Filter
from salesloom.sources.star import UNITS_PER_ONE, Star

NUMBERS = ("sales", "discount", "quantity", "shipping_cost")
PROFIT_FEATURES = ("ship_mode", "order_priority", "segment", "market", "region", "category", "sub_category")
PRIORITY_FEATURES = ("ship_mode", "segment", "market", "region", "category", "sub_category")

_NUMBER_FIELDS = [
    T.StructField("sales", T.DoubleType()),
    T.StructField("discount", T.DoubleType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("shipping_cost", T.DoubleType()),
]

PROFIT_SCHEMA = T.StructType(_NUMBER_FIELDS + [T.StructField(c, T.StringType()) for c in PROFIT_FEATURES])
PRIORITY_SCHEMA = T.StructType(_NUMBER_FIELDS + [T.StructField(c, T.StringType()) for c in PRIORITY_FEATURES])


# Holds the text of a record that does not parse.
UNPARSED = "_corrupt_record"


def schema_for(kind: str, unparsed: bool = False) -> T.StructType:
    fields = {"profit": PROFIT_SCHEMA, "priority": PRIORITY_SCHEMA}[kind]
    return T.StructType([*fields, T.StructField(UNPARSED, T.StringType())]) if unparsed else fields


def _reader(reader, kind: str, fmt: str, unparsed: bool):
    reader = reader.schema(schema_for(kind, unparsed and fmt in ("json", "csv"))).option("mode", "PERMISSIVE")
    reader = reader.option("columnNameOfCorruptRecord", UNPARSED)
    return (reader.option("header", True) if fmt == "csv" else reader).format(fmt)


def read_transactions(spark: SparkSession, path: str, kind: str = "profit", fmt: str = "json", unparsed: bool = False) -> DataFrame:
    """Records with the declared fields; what does not parse becomes null.

    ``unparsed`` adds a column with the text of such records, where the format is text.
    """
    return _reader(spark.read, kind, fmt, unparsed).load(path)


def stream_transactions(
    spark: SparkSession, path: str, kind: str = "profit", fmt: str = "json", files_per_batch: int | None = None, unparsed: bool = True
) -> DataFrame:
    reader = _reader(spark.readStream, kind, fmt, unparsed)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def star_transactions(star: Star, flt: Filter = NO_FILTER, extra=()) -> DataFrame:
    """Every order line as a transaction; discount in percent, as records have it."""
    amounts = {"sales": UNITS_PER_ONE, "discount": UNITS_PER_ONE // 100, "shipping_cost": UNITS_PER_ONE}
    columns = [f"{c}_units" if c in amounts else c for c in NUMBERS] + [*PROFIT_FEATURES, *extra]
    frame = lines(star, columns, flt, through=("orders", "customers", "products", "locations"))
    numbers = [
        (F.col(f"{c}_units").cast("double") / F.lit(float(amounts[c]))).alias(c) if c in amounts else F.col(c)
        for c in NUMBERS
    ]
    return frame.select(*numbers, *PROFIT_FEATURES, *extra)


def as_fractions(records: DataFrame) -> DataFrame:
    """Records with discounts in percent as records with fractions."""
    return records.withColumn("discount", F.col("discount") / F.lit(100.0))
