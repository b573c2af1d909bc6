"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenor.session import materialise


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _contracted(edges: DataFrame) -> DataFrame:
    """The edges with the pieces that lie in one Arrow batch as stars, so that chains take fewer rounds."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = np.concatenate([batch.column("u").to_numpy(), batch.column("v").to_numpy()])
            names, back = np.unique(ends, return_inverse=True)
            u, v = back[: batch.num_rows], back[batch.num_rows :]
            label = np.arange(len(names))
            while True:
                low = label.copy()
                np.minimum.at(low, u, label[v])
                np.minimum.at(low, v, label[u])
                low = low[low]
                if (low == label).all():
                    break
                label = low
            out = np.flatnonzero(label != np.arange(len(names)))
            yield pa.RecordBatch.from_arrays([pa.array(names[out]), pa.array(names[label[out]])], ["u", "v"])

    return edges.mapInArrow(run, "u bigint, v bigint")


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node that has an edge.

    Each step keeps one minimum per node, merged before the shuffle, and every
    round is written to the shared folder, so a hub is never gathered and no
    lineage grows. Self-loops and repeated edges change nothing.
    """
    edges = materialise(_contracted(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")).distinct(), "edges")
    state = _state(edges)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialise(small.where("u <> v").distinct(), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def joined_components(known: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """``known`` (node, component) after further edges: these are followed between components only, which are few."""
    label = known.withColumnRenamed("node", "__n").withColumnRenamed("component", "__c")
    moved = edges.select(F.col(a).alias("__a"), F.col(b).alias("__b"))
    for end in ("__a", "__b"):
        moved = moved.join(label, F.col(end) == F.col("__n"), "left").withColumn(end, F.coalesce("__c", end)).drop("__n", "__c")
    step = components(moved, "__a", "__b").withColumnRenamed("node", "__n").withColumnRenamed("component", "__c")
    again = known.join(step, F.col("component") == F.col("__n"), "left").select("node", F.coalesce("__c", "component").alias("component"))
    fresh = step.join(known, F.col("__n") == F.col("node"), "left_anti").select(F.col("__n").alias("node"), F.col("__c").alias("component"))
    return materialise(again.unionByName(fresh), "components")
