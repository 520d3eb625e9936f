"""Embedding whitening with distributed block matrices.

Vectors are fixed-point numbers. The rows that fit the transform are centred, indexed and cut into blocks
of some megabytes; the transposed matrix times itself is the scatter, whose size depends on the width of
the vectors alone, so its eigenvectors are computed on the driver. All rows, as blocks too, are multiplied
by the whitening matrix. The middle dimension of the scatter is split, so that no task gets all blocks.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.common import kept, table

SCALE, SHIFT = 64.0, 1_000_000
#: Entries beyond this are no fixed-point numbers whose sums a long can hold.
LARGEST = float(2**44)
BLOCK_BYTES, BLOCK_COLUMNS = 4 << 20, 1024
#: Eigenvalues below this share of the trace are rounding errors of a zero.
RANK = 1e-11
SCHEMA = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")


class Fit(NamedTuple):
    """What the rows that fit the transform give: count, sums by dimension, eigenvalues of the
    covariance in falling order, their unit vectors as columns, trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def fixed_point(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x, floor(64 * entry) + 1000000 for each entry as double. Left out: rows whose vector is
    NULL, is empty, or has a NULL, non-finite or too large entry."""
    entry = lambda c: c.cast("double")
    good = F.forall(vector, lambda c: F.coalesce(F.abs(entry(c)) <= LARGEST, F.lit(False)))
    x = F.transform(vector, lambda c: F.floor(entry(c) * SCALE).cast("long") + SHIFT)
    return rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & good).select("vec_id", x.alias("x"))


def indexed(rows: DataFrame, tag: str) -> tuple[DataFrame, int]:
    """The rows with a gapless `index` from 0, and how many they are. What a task has written is counted;
    the driver gets one number for each task."""
    numbered = kept(rows.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")), tag)
    counts = sorted((r.part, r.n) for r in numbered.groupBy("part").agg(F.count("*").alias("n")).collect())
    total, starts = 0, []
    for part, n in counts:
        starts.append((part, total))
        total += n
    starts = rows.sparkSession.createDataFrame(starts or [(0, 0)], "part int, start long")
    return numbered.join(F.broadcast(starts), "part").select("*", (F.col("start") + F.col("at")).alias("index")).drop("part", "at", "start"), total


def block_matrix(rows: DataFrame, n: int, width: int) -> BlockMatrix:
    """Blocks of the rows (index, centred)."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("centred").alias("vector")), "vector")
    columns = min(width, BLOCK_COLUMNS)
    return IndexedRowMatrix(vectors, n, width).toBlockMatrix(max(64, BLOCK_BYTES // (8 * columns)), columns)


def times(a: BlockMatrix, b: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """a times b. Beyond one split, so many tasks share the blocks of the middle dimension and their
    products are added up."""
    return BlockMatrix(a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits), a.rowsPerBlock, b.colsPerBlock)


def scatter(m: BlockMatrix) -> np.ndarray:
    """The transposed matrix times itself; as large as the width squared."""
    blocks = -(-m.numRows() // m.rowsPerBlock)
    return times(m.transpose(), m, max(1, blocks // 4)).toLocalMatrix().toArray()


def local_blocks(spark: SparkSession, a: np.ndarray, rows_per_block: int) -> BlockMatrix:
    """A matrix of the driver (width by components) as blocks."""
    cut = [((i, 0), Matrices.dense(*p.shape, p.flatten("F"))) for i, p in enumerate(np.split(a, range(rows_per_block, len(a), rows_per_block)))]
    return BlockMatrix(spark.sparkContext.parallelize(cut, 1), rows_per_block, a.shape[1], *a.shape)


def rows_of(m: BlockMatrix) -> DataFrame:
    """index and `whitened`, an array."""
    got = callMLlibFunc("getIndexedRows", m.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return got.select("index", vector_to_array("vector").alias("whitened"))


def centred(x: str, n: int, sums: list[int]):
    """x less its mean: (n * x - sum) is exact, then one division."""
    return F.zip_with(x, F.lit(sums), lambda a, s: (a * n - s).cast("double") / F.lit(float(n)))


def sums_by_dimension(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Rows and exact sums; adds up in the tasks, the driver gets one row."""
    got = fit.agg(F.count("*").alias("n"), *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(width)]).first()
    return got.n, list(got[1:])


def whitening_fit(fit: DataFrame, n: int, sums: list[int]) -> tuple[Fit, BlockMatrix]:
    """Eigenvectors of the covariance (divisor n) of rows (index, centred), and the rows' blocks."""
    blocks = block_matrix(fit, n, len(sums))
    v = scatter(blocks) / n
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    # Either sign is right; the largest entry is made positive, so that runs agree.
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(sums))])
    return Fit(n, sums, values, vectors, float(np.trace(v))), blocks


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """One row per vector and component: vec_id, component (1: most variance), n, deviation, whitened,
    explained, identity_error.

    The fit list is each distinct fixed-point vector once: n rows, sums S. `deviation` is the sum of (n*x - S)^2
    over the dimensions, exact, NULL where a long can't hold it. Vectors of another length than most
    (ties: the longest) have no place in the matrix and are left out, as are the rows that
    `fixed_point` leaves out. Components without variance can't be scaled and are left out, so an empty
    table and a fit list of one vector give no rows. Ties: equal eigenvalues keep the order of the local
    solver. Repeated rows are each returned, but count once in the fit; a NULL vec_id is kept; other
    columns are not read.
    """
    spark = vectors.sparkSession
    points = fixed_point(vectors)
    width = points.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if width is None:
        return spark.createDataFrame([], SCHEMA)
    width = width.width
    points, total = indexed(points.where(F.size("x") == width), "vectors")
    distinct, n = indexed(points.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "distinct")
    n, sums = sums_by_dimension(distinct, width)
    fit, blocks = whitening_fit(distinct.select("index", centred("x", n, sums).alias("centred")), n, sums)
    k = int((fit.values[:components] > RANK * fit.trace).sum())
    if not k:
        return spark.createDataFrame([], SCHEMA)
    matrix = local_blocks(spark, fit.vectors[:, :k] / np.sqrt(fit.values[:k]), blocks.colsPerBlock)
    of_fit = times(blocks, matrix)
    error = float(np.abs(scatter(of_fit) / n - np.eye(k)).max())  # the rows are centred, so are their images
    everything = block_matrix(points.select("index", centred("x", n, sums).alias("centred")), total, width)
    square = lambda d: (d * d).cast("decimal(38,0)")
    apart = F.zip_with("x", F.lit(sums), lambda a, s: (a * n - s).cast("decimal(19,0)"))
    deviation = F.expr("try_cast(deviation as long)").alias("deviation")
    rows = points.select("vec_id", "index", F.aggregate(F.transform(apart, square), F.lit(0).cast("decimal(38,0)"), lambda a, b: (a + b).cast("decimal(38,0)")).alias("deviation"))
    explained = F.lit([float(v / fit.trace) for v in fit.values[:k]])
    return rows.join(rows_of(times(everything, matrix)), "index").select(
        "vec_id", deviation, F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table `embeddings`, 16 components. Cases: see `whiten`."""
    return whiten(table(spark, sf_dir, "embeddings"))
