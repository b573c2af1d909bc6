"""Shuffles of many small values as few binary rows, dealt evenly over partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shuffle_size(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session is sized for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def part_keys(spark: SparkSession, n: int) -> list[int]:
    """``n`` integers that ``repartition(n, column)`` sends to ``n`` different partitions."""
    found: dict[int, int] = {}
    step, start = 16 * n, 0
    while len(found) < n:
        ids = F.col("id").cast("int")
        rows = spark.range(start, start + step, numPartitions=1).select(ids.alias("k"), F.pmod(F.hash(ids), F.lit(n)).alias("p")).collect()
        for r in rows:
            found.setdefault(r["p"], r["k"])
        start += step
    return [found[p] for p in range(n)]


def deal(df: DataFrame, n: int, column: str = "part") -> DataFrame:
    """One partition per value of ``column``, whose values are 0 to n - 1."""
    keys = part_keys(df.sparkSession, n)
    return df.withColumn("__deal", F.element_at(F.array(*map(F.lit, keys)), F.col(column) + 1)).repartition(n, "__deal").drop("__deal")


def dealt(part: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each part that occurs, the places of its values in their order."""
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(n + 1))
    for p in range(n):
        if ends[p + 1] > ends[p]:
            yield p, order[ends[p] : ends[p + 1]]


def record_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def spark_schema(schema: pa.Schema) -> str:
    names = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.float64(): "double", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)
