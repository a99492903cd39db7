"""Writing results and tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesloom.plans.fact import stored_tables
from salesloom.sources.star import Star


def export_csv(frame: DataFrame, path: str) -> None:
    """CSV with a header; fields are quoted where needed, null is empty."""
    flat = [
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name)
        for f in frame.schema.fields
    ]
    (
        frame.select(*flat)
        .write.mode("overwrite")
        .option("header", True)
        .option("nullValue", "")
        .option("emptyValue", "")
        .option("escape", '"')
        .csv(path)
    )


def write_star(star: Star, path: str) -> None:
    """Store the five tables in full, so that later queries only read them.

    Lines are laid out by year and week. A star loaded with ``dated_lines`` derives a
    range of years from a date filter, which skips the files and row groups outside it; the
    further columns let the ranges split an order that holds very many lines.
    """
    for name, frame in stored_tables(star).items():
        if name == "order_items":
            frame = frame.repartitionByRange("year", "week_num", "order_key", "product_id", "row_id", "sales")
        frame.write.mode("overwrite").parquet(f"{path}/{name}")


def write_star_tables(star: Star, path: str, prefix: str, buckets: int) -> None:
    """Store the five tables in the catalog as ``<prefix>_<table>``, files under ``path``.

    Lines and orders lie in equal buckets of the order key: their join and the sums by order
    need no exchange of the lines. Within a bucket lines are sorted by year, so that the range of
    years of a date filter skips row groups. An order with very many lines stays in one bucket;
    choose ``buckets`` so that a bucket of the rest is of a task's size.
    """
    for name, frame in stored_tables(star).items():
        writer = frame.write.format("parquet").mode("overwrite").option("path", f"{path}/{name}")
        if name in ("order_items", "orders"):
            frame = frame.repartition(buckets, "order_key")  # one file per bucket
            sorting = ["year", "order_key"] if name == "order_items" else ["order_key"]
            writer = frame.write.format("parquet").mode("overwrite").option("path", f"{path}/{name}")
            writer = writer.bucketBy(buckets, "order_key").sortBy(*sorting)
        writer.saveAsTable(f"{prefix}_{name}")
