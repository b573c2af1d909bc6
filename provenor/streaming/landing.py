"""Incremental landing index: each run picks up the files that arrived since the last one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from provenor.functions import file_name

LANDED_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def landed_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New files under ``run_date=`` folders with their run date, name and size."""
    files = spark.readStream.format("binaryFile").schema(LANDED_SCHEMA).option("recursiveFileLookup", True).load(folder)
    return files.select(
        F.nullif(F.regexp_extract("path", r"run_date=([^/]+)", 1), F.lit("")).alias("run_date"),
        file_name("path").alias("filename"),
        "path",
        F.col("length").alias("size"),
        F.col("modificationTime").alias("landed_at"),
    )


def index_new_files(spark: SparkSession, folder: str, index_path: str, checkpoint: str) -> StreamingQuery:
    """Append the new files to the index once and stop; the checkpoint remembers what was seen."""
    return (
        landed_stream(spark, folder).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(index_path)
    )
