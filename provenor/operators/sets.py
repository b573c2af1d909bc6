"""Unions, differences and upserts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def union_all(spark: SparkSession, frames: Sequence[DataFrame], schema: StructType | str) -> DataFrame:
    """Union by name; an empty typed frame when there is nothing to unite."""
    if not frames:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, frames)


def both_directions(edges: DataFrame, src: str, dst: str, node: str = "node", other: str = "neighbour") -> DataFrame:
    """Every edge seen from each of its ends, in one pass over the edges."""
    rest = [c for c in edges.columns if c not in (src, dst)]
    ends = F.array(
        F.struct(F.col(src).alias(node), F.col(dst).alias(other)),
        F.struct(F.col(dst).alias(node), F.col(src).alias(other)),
    )
    return edges.select(F.inline(ends), *rest)


def all_nodes(edges: DataFrame, src: str, dst: str, listed: DataFrame, node: str) -> DataFrame:
    """Distinct nodes of a list and of both edge ends."""
    ends = edges.select(F.explode(F.array(src, dst)).alias(node))
    return listed.select(node).unionByName(ends).distinct()


def id_diff(current: DataFrame, desired: DataFrame, key: str) -> DataFrame:
    """Ids only on one side: ``stale`` (current only) or ``new`` (desired only)."""
    have = current.select(key).distinct().withColumn("__have", F.lit(True))
    want = desired.select(key).distinct().withColumn("__want", F.lit(True))
    both = have.join(want, key, "full_outer")
    state = F.when(F.col("__want").isNull(), "stale").when(F.col("__have").isNull(), "new")
    return both.select(key, state.alias("state")).where(F.col("state").isNotNull())


def upsert(current: DataFrame, incoming: DataFrame, key: str, keep_stale: bool = False) -> DataFrame:
    """Incoming rows; with ``keep_stale`` also the current rows they do not replace."""
    fresh = incoming.select(*current.columns)
    if not keep_stale:
        return fresh
    return current.join(incoming.select(key), key, "left_anti").select(*current.columns).unionByName(fresh)
