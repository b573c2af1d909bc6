"""Planning of downloads and audit of landed files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenor.functions import file_name

MANIFEST_SCHEMA = (
    "dataset string, tax_id string, species string, string_version string, url string, filename string, hdfs_subdir string"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(path)


def plan_manifest(df: DataFrame, root: str, run_date: str | Column, subdir: str = "hdfs_subdir", name: str = "filename") -> DataFrame:
    """Target file and its index and error folders for every manifest row."""
    run = F.concat(F.lit("run_date="), F.lit(run_date) if isinstance(run_date, str) else run_date)
    return df.withColumns({
        "raw_dir": F.concat_ws("/", F.lit(root), F.col(subdir), run),
        "index_dir": F.concat_ws("/", F.lit(f"{root}/metadata/file_index"), run),
        "error_dir": F.concat_ws("/", F.lit(f"{root}/metadata/error"), run),
    }).withColumn("raw_path", F.concat_ws("/", "raw_dir", name))


def landed_files(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Landed files with name and size from the listing; no content is read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path"), file_name("path").alias("filename"), F.col("length").alias("size"), F.col("modificationTime").alias("landed_at"))


def line_digests(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines and a digest of the lines of each text file, added up from blocks, so that no file meets in one task.

    Equal files have equal digests; the order of lines does not count.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    total = F.sum(F.xxhash64("value").cast("decimal(38,0)"))
    return lines.groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"), total.cast("string").alias("digest")).withColumn("filename", file_name("path"))


def index_landed(manifest: DataFrame, landed: DataFrame, key: str, checks: Sequence[str]) -> DataFrame:
    """Every manifest row with its status: matched, missing, or mismatched on a check column.

    A check column is compared where the manifest states a value.
    """
    found = landed.select(key, *[F.col(c).alias(f"landed_{c}") for c in checks], F.lit(True).alias("__here"))
    joined = manifest.join(found, key, "left")
    differs = F.lit(False)
    for c in checks:
        differs = differs | (F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"landed_{c}")))
    status = F.when(F.col("__here").isNull(), "missing").when(differs, "mismatched").otherwise("matched")
    return joined.withColumn("status", status).drop("__here")


def split_landed(indexed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file index, error table)."""
    return indexed.where("status = 'matched'"), indexed.where("status <> 'matched'")
