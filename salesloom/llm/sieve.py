"""A filter of bounded size for wanted keys, passed over a larger table before a shuffle.

Each wanted key sets one bit, chosen by its hash. The bits lie in at most `ROWS`
rows of 64 bits, so what is broadcast has that bound however many keys there are.
A row whose bit is not set has no wanted key; a row whose bit is set may have one.
An exact join must follow. With many more keys than bits the filter lets nearly
all rows through, which costs shuffling and changes no result.

Defined results: a null key has a hash like any other; with no wanted key nothing
passes; columns of the frame are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = 1 << 20


def sifted(frame: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of frame whose `key` may be among the wanted ones."""
    bits = wanted.select(_row(key).alias("sieve row"), _bit(key).alias("bit")).groupBy("sieve row").agg(F.bit_or("bit").alias("sieve bits"))
    met = frame.withColumn("sieve row", _row(key)).join(F.broadcast(bits), "sieve row")
    return met.where(F.col("sieve bits").bitwiseAND(_bit(key)) != 0).select(frame.columns)


def marked(frame: DataFrame, wanted: DataFrame, key: str, out: str) -> DataFrame:
    """All rows of frame, with a flag `out` whether their `key` may be among the wanted ones."""
    bits = wanted.select(_row(key).alias("sieve row"), _bit(key).alias("bit")).groupBy("sieve row").agg(F.bit_or("bit").alias("sieve bits"))
    met = frame.withColumn("sieve row", _row(key)).join(F.broadcast(bits), "sieve row", "left")
    maybe = F.coalesce(F.col("sieve bits").bitwiseAND(_bit(key)) != 0, F.lit(False))
    return met.select(*[F.col(f"`{c}`") for c in frame.columns], maybe.alias(out))


def _row(key: str) -> Column:
    return F.pmod(F.shiftrightunsigned(F.xxhash64(key), 6), F.lit(ROWS))


def _bit(key: str) -> Column:
    return F.expr(f"shiftleft(1L, cast(xxhash64(`{key}`) & 63 as int))")
