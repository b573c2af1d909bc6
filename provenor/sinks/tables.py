"""Parquet, JSON, CSV, metric and vector sinks."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, StructType

from provenor.functions import csv_guard, finite_or_null
from provenor.operators.sets import upsert
from provenor.sources.tables import find_snapshot


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Overwrite as Snappy Parquet; with partitions only those that occur are replaced."""
    writer = df.write.mode("overwrite").option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def write_sized(df: DataFrame, path: str, n_files: int | None = None, partition_by: Sequence[str] = ()) -> None:
    """Even output files: a given number, or whatever size adaptive execution advises.

    The rebalance hint also splits a partition value that holds most of the rows.
    """
    sized = df.repartition(n_files) if n_files else df.hint("rebalance", *partition_by)
    write_table(sized, path, partition_by)


def _scrub(c: Column, t: DataType) -> Column:
    if isinstance(t, (DoubleType, FloatType)):
        return finite_or_null(c)
    if isinstance(t, StructType):
        return F.when(c.isNotNull(), F.struct(*[_scrub(c[f.name], f.dataType).alias(f.name) for f in t]))
    if isinstance(t, ArrayType):
        return F.transform(c, lambda x: _scrub(x, t.elementType))
    return c


def scrub_nonfinite(df: DataFrame) -> DataFrame:
    """NaN and infinities, also nested ones, become null."""
    return df.select(*[_scrub(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def write_snapshot(df: DataFrame, path: str) -> None:
    """One JSON object per row, nulls kept, written by the executors."""
    scrub_nonfinite(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def csv_lines(df: DataFrame, order: Sequence[Column] = ()) -> DataFrame:
    """Guarded, fully quoted CSV lines in order; the first line holds the byte order mark and the header."""
    def quoted(c: Column) -> Column:
        return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))

    rows = df.orderBy(*order) if order else df
    body = rows.select(F.concat_ws(",", *[quoted(csv_guard(F.col(f"`{c}`"))) for c in df.columns]).alias("value"))
    head = df.sparkSession.range(1).select(
        F.concat(F.lit("\ufeff"), F.concat_ws(",", *[quoted(csv_guard(F.lit(c))) for c in df.columns])).alias("value")
    )
    return head.union(body)


def export_csv(df: DataFrame, path: str, order: Sequence[Column] = ()) -> None:
    """Part files that form one CSV file when put together in name order."""
    csv_lines(df, order).write.mode("overwrite").text(path)


def metrics_table(df: DataFrame, specs: Mapping[str, tuple[Column, str]]) -> DataFrame:
    """``{name: (aggregate, details)}`` as rows of name, text value, details and UTC time, in one pass."""
    names = list(specs)
    one = df.agg(*[specs[n][0].cast("string").alias(f"m{i}") for i, n in enumerate(names)])
    rows = F.array(*[
        F.struct(F.lit(n).alias("metric_name"), F.col(f"m{i}").alias("metric_value"), F.lit(specs[n][1]).alias("details"))
        for i, n in enumerate(names)
    ])
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    return one.select(F.inline(rows)).withColumn("created_at", F.concat(stamp, F.lit("Z")))


def write_observed(df: DataFrame, path: str, specs: Mapping[str, tuple[Column, str]], partition_by: Sequence[str] = (), sized: bool = False) -> DataFrame:
    """Writes ``df`` and returns the metrics of the written rows, gathered by the write itself.

    ``specs`` are as for ``metrics_table``; aggregates of distinct values need a pass of their own and are refused
    by Spark here. The rows are observed in the writing stage, after any shuffle.
    """
    seen, names = Observation(f"write-{uuid.uuid4().hex}"), list(specs)
    rows = df.hint("rebalance", *partition_by) if sized else df
    write_table(rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[specs[n][0].cast("string").alias(f"m{i}") for i, n in enumerate(names)]), path, partition_by)
    values = seen.get
    found = [(n, values.get(f"m{i}"), specs[n][1]) for i, n in enumerate(names)]
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    made = df.sparkSession.createDataFrame(found, "metric_name string, metric_value string, details string")
    return made.withColumn("created_at", F.concat(stamp, F.lit("Z")))


def export_vectors(df: DataFrame, path: str, key: str, document: str, metadata: str, vector: str) -> None:
    write_table(df.select(
        F.col(key).alias("id"), F.col(document).alias("document"), F.col(metadata).alias("metadata"),
        F.col(vector).cast("array<float>").alias("embedding"),
    ), path)


def hydrate(live: DataFrame, snapshot: DataFrame, key: str) -> DataFrame:
    """The live rows; when there are fewer than snapshot rows, the snapshot is put over them."""
    def size(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1)).alias("n")).scalar()

    short = size(live) < size(snapshot)
    kept = live.join(snapshot.select(key).where(short), key, "left_anti").select(*live.columns)
    return kept.unionByName(snapshot.select(*live.columns).where(short))


def sync_snapshots(spark: SparkSession, source: str, names: Sequence[str], target: str) -> list[str]:
    """Every named snapshot replaces its own target dataset; returns the names without a snapshot, whose targets stay."""
    absent = []
    for name in names:
        rows = find_snapshot(spark, source, name)
        if rows is None:
            absent.append(name)
        else:
            rows.write.mode("overwrite").json(f"{target}/{name}")
    return absent


def refresh(current: DataFrame, incoming: DataFrame, key: str, path: str) -> None:
    """Full refresh of a keyed table: stale rows go, others are replaced or added."""
    write_table(upsert(current, incoming, key), path)
