"""Interaction graph: degree, neighbourhood features, sub-graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenor import constants as K
from provenor.operators.filters import min_weight
from provenor.operators.joins import attach_ends
from provenor.operators.sets import both_directions


def degrees(edges: DataFrame, src: str, dst: str, weight: str, node: str = "node", dedup: bool = False, parts: int = 0) -> DataFrame:
    """Distinct neighbours and summed weight per node.

    Weights add up over all rows, so an edge listed in both directions counts
    twice unless ``dedup``. Each (node, neighbour) pair is summed first; a hub is
    thereby spread over its neighbours before its own total is formed. ``parts``
    deals the pairs over that many tasks (``session.tasks_for`` twice the edges);
    without it the session's shuffle partitions decide.
    """
    seen = both_directions(edges.select(src, dst, weight), src, dst, node, "__other")
    if parts:
        seen = seen.repartition(parts, node, "__other")
    if dedup:
        seen = seen.distinct()
    pairs = seen.groupBy(node, "__other").agg(F.sum(weight).alias("__w"))
    return pairs.groupBy(node).agg(F.count("__other").alias("degree"), F.sum("__w").cast("double").alias("weighted_degree"))


def incident_edges(edges: DataFrame, nodes: DataFrame, node: str, src: str, dst: str) -> DataFrame:
    """Distinct edges with at least one end among the nodes.

    Each end is marked by its own equi-join, so the edges are read once and no
    join condition holds an OR.
    """
    ids = nodes.select(node).where(F.col(node).isNotNull()).distinct()
    from_src = ids.select(F.col(node).alias(src), F.lit(True).alias("__src"))
    from_dst = ids.select(F.col(node).alias(dst), F.lit(True).alias("__dst"))
    marked = edges.join(from_src, src, "left").join(from_dst, dst, "left")
    return marked.where(F.coalesce("__src", "__dst", F.lit(False))).select(*edges.columns).distinct()


def interaction_features(
    edges: DataFrame, nodes: DataFrame, node: str, src: str, dst: str, score: str, weight: str,
    threshold: float = K.EDGE_MIN_WEIGHT, high: float = K.EDGE_HIGH_WEIGHT, parts: int = 0,
) -> DataFrame:
    """Neighbours, mean and best score and high-confidence neighbours of the given nodes.

    Edges are summed per pair and per node before the nodes are picked, so the
    join meets one row per node and no hub. ``parts`` is as for ``degrees``.
    """
    strong = min_weight(edges.select(src, dst, score, weight), weight, threshold)
    ids = nodes.select(node).where(F.col(node).isNotNull()).distinct()
    seen = both_directions(strong, src, dst, node, "__other")
    seen = (seen.repartition(parts, node, "__other") if parts else seen).distinct()
    pairs = seen.groupBy(node, "__other").agg(
        F.sum(score).alias("__sum"), F.count(score).alias("__n"), F.max(score).alias("__max"),
        F.max(F.col(weight) >= high).alias("__high"),
    )
    totals = pairs.groupBy(node).agg(
        F.count("__other").alias("n_interactions"),
        F.try_divide(F.sum("__sum"), F.sum("__n")).alias("avg_score"),
        F.max("__max").alias("max_score"),
        F.count_if(F.col("__high") & F.col("__other").isNotNull()).alias("n_high"),
    )
    return totals.join(ids, node, "left_semi")


def induced_subgraph(
    edges: DataFrame, nodes: DataFrame, node: str, src: str, dst: str, weight: str,
    threshold: float = K.EDGE_MIN_WEIGHT, attrs: Sequence[str] = (),
) -> DataFrame:
    """Edges with both ends among the nodes and enough weight, with node attributes at both ends.

    With ``attrs`` the nodes must be unique; their attributes then come with the
    same two joins that select the edges.
    """
    kept = min_weight(edges, weight, threshold)
    if not attrs:
        ids = nodes.select(node).distinct()
        return kept.join(ids.withColumnRenamed(node, src), src, "left_semi").join(ids.withColumnRenamed(node, dst), dst, "left_semi")
    return attach_ends(kept, nodes.select(node, *attrs), node, src, dst, how="inner")


def ego_nodes(nodes: DataFrame, edges: DataFrame, node: str, centre: str, src: str, dst: str) -> DataFrame:
    """The centre and its direct neighbours in either direction, as far as they are among the nodes."""
    around = edges.where((F.col(src) == centre) | (F.col(dst) == centre)).select(F.explode(F.array(src, dst)).alias(node))
    return nodes.where(F.col(node) == centre).unionByName(nodes.where(F.col(node) != centre).join(around.distinct(), node, "left_semi").select(*nodes.columns))


def ego_network(
    nodes: DataFrame, edges: DataFrame, node: str, centre: str | None, src: str, dst: str, weight: str,
    rank: str, top_n: int, keep=None, threshold: float = K.EDGE_MIN_WEIGHT,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a neighbourhood view.

    First the best ``top_n`` by rank, then the ``keep`` condition, then the
    neighbourhood of ``centre`` (found without the weight threshold), and last
    the edges among the nodes that remain.
    """
    chosen = nodes.orderBy(F.col(rank).asc_nulls_last(), F.col(node)).limit(top_n)
    if keep is not None:
        chosen = chosen.where(F.coalesce(keep, F.lit(False)))
    if centre is not None:
        chosen = ego_nodes(chosen, edges, node, centre, src, dst)
    return chosen, induced_subgraph(edges, chosen, node, src, dst, weight, threshold)
