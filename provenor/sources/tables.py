"""Parquet tables, catalog tables and snapshot datasets."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_table_or_path(spark: SparkSession, name: str, path: str) -> DataFrame:
    """The catalog table or view when it exists, otherwise the Parquet path."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.read.parquet(path)


def snapshot_rows(df: DataFrame) -> DataFrame:
    """Rows of a payload: the elements of ``items`` where there is such a list, else the rows themselves."""
    kind = df.schema["items"].dataType if "items" in df.columns else None
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        return df.select(F.inline("items"))
    return df


def read_snapshot(
    spark: SparkSession, root: str, name: str, schema: StructType | str | None = None, multi_line: bool | None = None
) -> DataFrame:
    """Rows of ``root/name.json`` (a list, an object or ``{items: [...]}``) or of the folder ``root/name``.

    Folders hold one object per line unless ``multi_line``. A missing snapshot
    gives no rows: with the given schema, else one ``available`` column.
    """
    found = find_snapshot(spark, root, name, schema, multi_line)
    return found if found is not None else spark.createDataFrame([], schema if schema is not None else "available boolean")


def find_snapshot(
    spark: SparkSession, root: str, name: str, schema: StructType | str | None = None, multi_line: bool | None = None
) -> DataFrame | None:
    """The rows of a snapshot, or None where there is none."""
    for path, whole in ((f"{root}/{name}.json", True), (f"{root}/{name}", bool(multi_line))):
        reader = spark.read.option("multiLine", whole)
        if schema is not None:
            reader = reader.schema(schema)
        try:
            return snapshot_rows(reader.json(path))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return None
