"""Operator 12: whitening of embeddings by distributed block matrices.

Entries become whole numbers x, so sums and distances are exact. The rows are
numbered, written once, centred (n * x - S is a whole number, then divided by n) and
dealt into the blocks of an MLlib BlockMatrix A. The transposed matrix times A, its middle
dimension split into parts that are added up by key, is the scatter matrix; only that
square of dimensions reaches the driver, where its eigenvectors are found.
A times the whitening matrix gives the rows on the components.

Blocks grow with the table between ROWS rows and CELLS entries, so that the list of
block coordinates, which the multiplication keeps on the driver, stays short.

Defined results: rows whose vector is null, or holds a null or non-finite entry, are
left out, and so are vectors of another length than most (of two lengths equally
frequent the longer one stays); entries beyond 2^42 count as 2^42; repeated rows
are counted each; components without spread (all rows equal, fewer rows than dimensions)
are left out, so a single row has none; an empty table gives an empty table;
columns of the table are kept, one named like `out` is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Vectors
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salesloom.llm.columns import packed, unpacked
from salesloom.session import stored

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
FARTHEST = 2.0**42  # entries beyond count as this
ROWS = 1024  # rows of a block, at least
BLOCKS = 256  # row blocks wanted before blocks grow
CELLS = 1 << 22  # entries of a block, at most: 32 MB
SPLIT = 8  # row blocks added up by one task
COLUMNS = 1024  # columns of a block
FLAT = 1e-12  # of the trace: no spread


@dataclass
class Whitening:
    """What the rows are projected with; `matrix` is dimensions by components."""

    n: int
    sums: list[int]
    values: np.ndarray  # variances of the components, falling
    matrix: np.ndarray
    trace: float


def whiten(frame: DataFrame, vector: str = "embedding", components: int = COMPONENTS, out: str = "whitening") -> DataFrame:
    """The rows with a usable vector and a struct `out`.

    It holds n, deviation (decimal: sum over the dimensions of (n * x - S)^2), the
    whitened coordinates and explained shares by component, and identity_error: the
    largest entry of the coordinates' covariance minus the identity.
    """
    spark = frame.sparkSession
    rows = _numbered(frame, vector)
    n, sums = _sums(rows)
    blocks, model = _fitted(rows, n, sums, components)
    share = F.array(*[F.lit(float(v / model.trace)) for v in model.values]).cast("array<double>")
    deviation = F.aggregate(_apart(n, sums), F.lit(0).cast("decimal(38,0)"), lambda s, d: (s + d.cast("decimal(19,0)") * d.cast("decimal(19,0)")).cast("decimal(38,0)"))
    if len(model.values):
        placed = stored(_projected(spark, blocks, model, len(sums)), "whitened")
        met = rows.join(placed, "index")
    else:
        met = rows.withColumn("whitened", F.array().cast("array<double>"))
        placed = met.select("whitened")
    error = _identity_error(placed, len(model.values))
    result = F.struct(
        F.lit(n).cast("long").alias("n"),
        deviation.alias("deviation"),
        F.col("whitened"),
        share.alias("explained"),
        F.lit(error).alias("identity_error"),
    )
    return unpacked(met.select("row", result.alias("whitening")), frame.columns, **{out: "whitening"})


def _usable(vector: str) -> Column:
    entry = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(math.inf))
    return F.coalesce(F.forall(F.col(vector).cast("array<double>"), entry), F.lit(False))


def _numbered(frame: DataFrame, vector: str) -> DataFrame:
    """Usable rows, written once: row, x and a running number `index` from 0."""
    near = lambda v: F.greatest(F.least(v, F.lit(FARTHEST)), F.lit(-FARTHEST))
    whole = F.transform(F.col("v").cast("array<double>"), lambda v: F.floor(near(v) * SCALE) + F.lit(SHIFT).cast("long"))
    usable = packed(frame, v=vector).where(_usable("v")).select("row", whole.alias("x"))
    sizes = usable.where(F.size("x") > 0).groupBy(F.size("x").alias("size")).count()
    most = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    usable = usable.where(F.size("x") == (most["size"] if most else -1))
    place = F.monotonically_increasing_id()
    part, at = F.shiftrightunsigned(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")
    rows = stored(usable.select("row", "x", part, at), "vectors")
    sizes = rows.groupBy("part").count()  # one row per written partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    opened = sizes.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("opened"))
    return rows.join(opened, "part").select((F.col("opened") + F.col("at")).alias("index"), "row", "x")


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and the sum of each dimension."""
    entries = rows.select(F.posexplode("x").alias("d", "v"))
    found = entries.groupBy("d").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(20,0)")).alias("s")).orderBy("d").collect()
    return (found[0]["n"] if found else 0), [int(r["s"]) for r in found]


def _apart(n: int, sums: list[int]) -> Column:
    """n * x - S by dimension: whole numbers."""
    total = F.array(*[F.lit(s).cast("decimal(38,0)") for s in sums]).cast("array<decimal(38,0)>")
    return F.zip_with("x", total, lambda x, s: (x.cast("decimal(19,0)") * F.lit(n).cast("decimal(18,0)") - s).cast("decimal(38,0)"))


def _fitted(rows: DataFrame, n: int, sums: list[int], components: int) -> tuple[BlockMatrix | None, Whitening]:
    """Centred blocks, and the whitening from their scatter matrix."""
    size = len(sums)
    if n == 0:
        return None, Whitening(0, [], np.empty(0), np.empty((0, 0)), 0.0)
    centred = F.transform(_apart(n, sums), lambda d: d.cast("double") / F.lit(float(n)))
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(centred).alias("vector")), "vector")
    high = max(1, min(max(ROWS, -(-n // BLOCKS)), CELLS // min(size, COLUMNS)))
    blocks = IndexedRowMatrix(vectors, n, size).toBlockMatrix(high, COLUMNS)
    splits = max(1, -(-n // (high * SPLIT)))
    scatter = _times(blocks.transpose(), blocks, splits).toLocalMatrix().toArray()
    values, axes = np.linalg.eigh((scatter + scatter.T) / (2.0 * n))
    trace = float(values.sum())
    order = [k for k in np.argsort(-values)[:components] if values[k] > FLAT * trace]
    return blocks, Whitening(n, sums, values[order], axes[:, order] / np.sqrt(values[order]), trace)


def _times(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """The product, its middle dimension cut into parts that are multiplied apart and added by key."""
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def _projected(spark: SparkSession, blocks: BlockMatrix, model: Whitening, size: int) -> DataFrame:
    """(index, whitened) of every row."""
    table = spark.createDataFrame([(k, Vectors.dense(model.matrix[k])) for k in range(size)], ["index", "vector"])
    by = IndexedRowMatrix(table, size, len(model.values)).toBlockMatrix(COLUMNS, COLUMNS)
    product = blocks.multiply(by).toIndexedRowMatrix()
    rows = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    return MLUtils.convertVectorColumnsToML(rows, "vector").select("index", vector_to_array("vector").alias("whitened"))


def _identity_error(placed: DataFrame, components: int) -> float:
    """Largest absolute entry of the covariance of the coordinates, less the identity; 0 without components."""
    if not components:
        return 0.0
    at = [F.col("whitened")[k] for k in range(components)]
    means = placed.agg(*[F.avg(c) for c in at]).first()
    pairs = [(i, j) for i in range(components) for j in range(i + 1)]
    products = placed.agg(*[F.avg((at[i] - means[i]) * (at[j] - means[j])) for i, j in pairs]).first()
    return float(max(abs(v - (i == j)) for (i, j), v in zip(pairs, products)))
