"""Whitening of embeddings with MLlib's distributed block matrices.

Rows are numbered, centred and laid into blocks. The blocks of the transposed
matrix times the matrix, summed over the row blocks, give the scatter matrix, whose
eigenvectors one machine finds (its size is the number of dimensions, whatever the number
of rows). A product of the blocks with the whitening matrix projects all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenor.llm.packing import shuffle_size
from provenor.operators.ordering import number_rows
from provenor.session import materialise

ROWS_PER_BLOCK = 2048
LARGEST = float(1 << 52)  # entries beyond are not whole doubles any more


def finite(vector: Column) -> Column:
    """Whether the vector is there and no entry is null, NaN or infinite."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows with a finite vector of the usual length: the one that most rows have, of several the largest; empty vectors have none."""
    rows = df.where(finite(F.col(vector)) & (F.size(vector) > 0))
    usual = rows.groupBy(F.size(vector).alias("n")).count().orderBy(F.col("count").desc(), F.col("n").desc()).first()
    return rows.where(F.size(vector) == (usual["n"] if usual else 0))


def scaled(vector: Column, scale: float = 64.0, shift: int = 1_000_000) -> Column:
    """Entries as long integers floor(scale * c) + shift; an entry too large for a double to be whole counts as infinite."""
    def one(c: Column) -> Column:
        x = F.floor(c.cast("double") * F.lit(scale))
        return F.when(F.abs(c.cast("double") * F.lit(scale)) < LARGEST, x + F.lit(shift).cast("bigint"))

    return F.transform(vector, one)


def block_matrix(rows: DataFrame, index: str, vector: str, n: int, dims: int) -> BlockMatrix:
    """Rows numbered from 0 (``index``) with arrays of doubles as blocks, made in the JVM."""
    vectors = rows.select(F.col(index).alias("index"), array_to_vector(F.col(vector)).alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), n, dims).toBlockMatrix(ROWS_PER_BLOCK, dims)


def scatter(blocks: BlockMatrix, parts: int) -> np.ndarray:
    """The transposed matrix times the matrix. Row blocks meet their counterparts in ``parts`` tasks, and only products are summed."""
    turned = blocks.transpose()
    product = turned._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, int(parts))
    return BlockMatrix(product, turned.rowsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def project(spark: SparkSession, blocks: BlockMatrix, matrix: np.ndarray) -> DataFrame:
    """``index`` and ``projected`` (array of doubles): each row times ``matrix``."""
    dims, k = matrix.shape
    local = DenseMatrix(dims, k, matrix.ravel(order="F"))
    right = BlockMatrix(spark.sparkContext.parallelize([((0, 0), local)], 1), dims, k, dims, k)
    rows = callMLlibFunc("getIndexedRows", blocks.multiply(right).toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select("index", vector_to_array("vector").alias("projected"))


def column_sums(rows: DataFrame, vector: str) -> list:
    """The sum of each entry over all rows, merged before the shuffle; whole numbers stay exact."""
    entries = rows.select(F.posexplode(vector).alias("i", "x"))
    whole = dict(entries.dtypes)["x"] in ("tinyint", "smallint", "int", "bigint")
    sums = entries.groupBy("i").agg(F.sum(F.col("x").cast("decimal(20,0)") if whole else "x").alias("s")).orderBy("i").collect()
    return [int(r["s"]) if whole else float(r["s"]) for r in sums]


def _centred(vector: str, n: int, sums: list) -> Column:
    """Entries less their mean; (n * x - S) / n is exact up to the last step for whole numbers."""
    if all(isinstance(s, int) for s in sums):
        totals = F.expr("array(" + ",".join(f"cast({s} as decimal(38,0))" for s in sums) + ")")
        return F.zip_with(vector, totals, lambda x, s: (x.cast("decimal(20,0)") * F.lit(n).cast("decimal(17,0)") - s).cast("double") / F.lit(float(n)))
    means = F.expr("array(" + ",".join(f"double('{s / n!r}')" for s in sums) + ")")
    return F.zip_with(vector, means, lambda x, m: x - m)


@dataclass
class Whitening:
    """What was fitted, and ``rows``: the input's columns and ``whitened``, one value per component."""

    n: int
    sums: list
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None
    rows: DataFrame


def whiten(df: DataFrame, key: str, vector: str, components: int = 32) -> Whitening:
    """Whitens the vectors of ``df``, all finite and of one length (see ``usable``).

    Components are unit eigenvectors of the covariance (divisor n), numbered by
    falling eigenvalue, their largest entry positive. A component without
    variance, up to rounding, has null values and no part in ``identity_error``, which is null
    when there is none. Rows may share a key or have none; repeated rows each count. An
    empty table gives no rows. All columns of ``df`` come back; one named ``whitened`` gives way.
    """
    spark, parts = df.sparkSession, shuffle_size(df.sparkSession)
    kept = df.drop("whitened")
    numbered = number_rows(kept, [F.col(key).asc(), F.xxhash64(vector).asc()], position="__index").withColumn("__index", F.col("__index") - 1)
    rows = materialise(numbered, "vectors")
    n = rows.count()
    if not n:
        empty = kept.withColumn("whitened", F.lit(None).cast("array<double>")).limit(0)
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0, None, empty)
    sums = column_sums(rows, vector)
    dims = len(sums)
    blocks = block_matrix(rows.select("__index", _centred(vector, n, sums).alias("__centred")), "__index", "__centred", n, dims)
    covariance = scatter(blocks, parts) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(dims)])
    k = min(components, dims)
    real = values[:k] > dims * np.finfo(float).eps * values[0]
    matrix = np.where(real, vectors[:, :k] / np.sqrt(np.where(real, values[:k], 1.0)), 0.0)
    projected = materialise(project(spark, blocks, matrix), "projected")
    error = None
    if real.any():
        means = column_sums(projected, "projected")
        again = block_matrix(projected.select("index", _centred("projected", n, means).alias("c")), "index", "c", n, k)
        error = float(np.abs(scatter(again, parts) / n - np.eye(k))[np.ix_(real, real)].max())
    keep = F.expr("array(" + ",".join(str(bool(r)).lower() for r in real) + ")")
    whitened = F.zip_with("projected", keep, lambda x, ok: F.when(ok, x))
    out = rows.join(projected.withColumnRenamed("index", "__index"), "__index").withColumn("whitened", whitened).select(*kept.columns, "whitened")
    return Whitening(n, sums, values, vectors, float(np.trace(covariance)), error, out)


def deviation(vector: str, n: int, sums: list[int]) -> Column:
    """The exact sum over dimensions of (n * x - S)^2 of whole numbers; null where it is beyond a long."""
    totals = F.expr("array(" + ",".join(f"cast({s} as decimal(38,0))" for s in sums) + ")")
    gaps = F.zip_with(vector, totals, lambda x, s: (x.cast("decimal(20,0)") * F.lit(n).cast("decimal(17,0)") - s).cast("decimal(18,0)"))
    return F.aggregate(gaps, F.lit(0).cast("decimal(38,0)"), lambda a, g: (a + g * g).cast("decimal(38,0)")).try_cast("bigint")
