"""Published views of the ranking: every snapshot is a lazy DataFrame until it is written."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenor import constants as K
from provenor.functions import neg_log10, node_size
from provenor.operators import aggregates as agg
from provenor.operators.graph import induced_subgraph
from provenor.operators.joins import attach_one, missing
from provenor.operators.shape import heat_map, with_literals
from provenor.operators.sorting import top_k
from provenor.sinks.tables import write_snapshot
from provenor.session import materialise


def dashboard_rollups(parts: Mapping[str, tuple[DataFrame, Column]]) -> DataFrame:
    """Named single numbers, each one aggregate over its own frame."""
    rows = None
    for name, (df, value) in parts.items():
        one = df.agg(value.cast("double").alias("metric_value")).select(F.lit(name).alias("metric_name"), "metric_value")
        rows = one if rows is None else rows.unionByName(one)
    return rows


def volcano_points(diff: DataFrame) -> DataFrame:
    return diff.select(
        "gene_name", "gene_id_base", "log2FC", "p_value", neg_log10("p_value").alias("minus_log10_p_value"),
        neg_log10("p_value", plot_cap=K.NEG_LOG_PLOT_CAP).alias("plot_minus_log10_p_value"), "deg_direction", "is_deg",
    )


def top_different(diff: DataFrame) -> DataFrame:
    return diff.where("is_deg").withColumn("abs_log2FC", F.abs("log2FC"))


def largest_effect() -> list[Column]:
    return [F.col("abs_log2FC").desc(), F.col("gene_id_base").asc(), F.col("gene_name").asc()]


def overview(t: Mapping[str, DataFrame], edges: DataFrame) -> DataFrame:
    """Key figures of all phases from eleven one-number aggregates."""
    n = F.count(F.lit(1)).alias("n")
    passed = t["qc"].where(~(F.col("is_outlier_library_size") | F.col("is_outlier_detected_genes")))
    group = F.lower("sample_group")
    supported = t["geo_summary"].where(F.col("geo_support_level") != K.SUPPORT_NOT_FOUND)
    cells = [
        t["qc"].agg(n),
        passed.agg(n),
        passed.where(group == "tumor").agg(n),
        passed.where(group == "normal").agg(n),
        t["deg"].where("is_deg").agg(n),
        t["mapped"].agg(F.count_distinct("gene_id_base").alias("n")),
        t["candidate_features"].agg(n),
        edges.agg(n),
        t["top_enriched"].agg(n),
        supported.agg(F.coalesce(F.sum("candidate_count"), F.lit(0)).alias("n")),
        t["ml_summary"].agg(n),
    ]
    return agg.kpi_table([(name, cell, unit, phase, text) for cell, (name, unit, phase, text) in zip(cells, K.OVERVIEW_METRICS)])


def snapshots(t: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The 27 published views from the phase tables.

    ``t`` maps qc, expr, deg, mapped, candidate_features, top_enriched, geo_result,
    geo_summary, geo_supported, candidate_clusters, ml_k, ml_summary and edges.
    """
    qc, deg, mapped = t["qc"], t["deg"], t["mapped"]
    ok = ~(F.col("is_outlier_library_size") | F.col("is_outlier_detected_genes"))
    # both are used by several views; stored, they are read and joined once
    top = materialise(attach_one(t["top_enriched"], mapped, "protein_id", "gene_confidence"), "top").orderBy("rank")
    nodes = top.select(*K.NODE_COLUMNS, node_size("weighted_degree_protein").alias("node_size"))
    edges = materialise(induced_subgraph(
        t["edges"], top, "protein_id", "protein_id_src", "protein_id_dst", "edge_weight_protein", attrs=["gene_name"]
    ).select("protein_id_src", "protein_id_dst", "gene_name_src", "gene_name_dst", "combined_score_protein", "edge_weight_protein"), "edges")
    called = top_different(deg)
    unmapped = missing(called, mapped, ["gene_id_base"])
    shown = F.when(F.col("is_deg"), F.col("deg_direction")).otherwise(K.NOT_SIGNIFICANT)
    by_rank = t["geo_result"].orderBy("rank")
    summary = t["ml_summary"].orderBy("cluster_id")
    overlap = by_rank.select(*K.OVERLAP_COLUMNS).limit(K.TOP_N)
    counts = agg.pass_counts(qc, "sample_group", ok).toDF("sample_group", "samples_before_qc", "samples_after_qc", "samples_removed")
    return {
        "overview_summary": overview(t, edges),
        "qc_sample_counts": counts.orderBy("sample_group"),
        "qc_exclusion_summary": agg.exclusions(qc, "is_outlier_library_size", "is_outlier_detected_genes").orderBy(F.desc("sample_count")),
        "qc_library_size": agg.histogram(qc, "total_raw_count", K.LIBRARY_SIZE_EDGES, "number_of_samples", "sample_group"),
        "qc_zero_gene_rate": agg.histogram(qc, "pct_zero_genes", K.ZERO_RATE_EDGES, "number_of_samples", "sample_group"),
        "volcano_points": volcano_points(deg),
        "deg_summary": deg.groupBy(shown.alias("deg_direction")).agg(F.count(F.lit(1)).alias("gene_count")),
        "top_deg_genes": top_k(called, largest_effect(), 50).select("gene_name", "gene_id_base", "log2FC", "abs_log2FC", "p_value", "deg_direction"),
        "deg_heatmap_matrix": heat_map(
            t["expr"], "gene_name", "sample_id", "sample_group", "log2_tpm", ["tumor", "normal"],
            [F.col("abs_log2FC").desc(), F.col("gene_name")], called.groupBy("gene_name").agg(F.max("abs_log2FC").alias("abs_log2FC")),
        ),
        "gene_protein_mapping_summary": agg.mapping_summary(called, mapped, "gene_id_base"),
        "gene_protein_mapping_confidence": agg.distinct_by(mapped, "gene_confidence", "protein_id", "number_of_proteins").orderBy("gene_confidence"),
        "mapping_unmapped_genes": with_literals(
            top_k(unmapped, largest_effect(), 100), mapping_status=K.UNMAPPED_LABEL, mapping_reason=K.UNMAPPED_REASON
        ).select("gene_name", "gene_id_base", "log2FC", "p_value", "mapping_status", "mapping_reason"),
        "ppi_visualization_nodes": nodes.limit(K.TOP_N),
        "ppi_visualization_edges": edges,
        "network_top_proteins": nodes.orderBy(F.desc("weighted_degree_protein"), "rank").limit(K.TOP_N),
        "network_score_distribution": agg.histogram(edges, "edge_weight_protein", K.EDGE_WEIGHT_EDGES, "number_of_edges"),
        "top_candidate_targets_enriched": top,
        "geo_validation_summary": t["geo_summary"].select(
            "geo_support_level", F.col("candidate_count").alias("count"), F.col("candidate_percentage").alias("percentage")
        ),
        "geo_unmatched_candidates": by_rank.where(F.col("geo_support_level") == K.SUPPORT_NOT_FOUND).select(
            "rank", "gene_name", "protein_id", "final_score", "geo_validation_mode", "geo_match_status", "geo_support_level"
        ),
        "geo_supported_top_candidates": t["geo_supported"].orderBy("geo_support_rank").limit(K.TOP_N),
        "geo_gdc_vs_support_scatter": by_rank.select(*K.SCATTER_COLUMNS).limit(K.TOP_N),
        "geo_top_candidate_overlap": overlap,
        "geo_expression_availability": overlap,
        "ml_k_selection": t["ml_k"].orderBy("k"),
        "ml_cluster_points": t["candidate_clusters"].select(*K.SHOWN_POINT_COLUMNS),
        "ml_cluster_summary": summary,
        "ml_clusters": summary,
    }


def write_snapshots(views: Mapping[str, DataFrame], root: str) -> None:
    """One JSON dataset per view, written by the executors."""
    for name, df in views.items():
        write_snapshot(df, f"{root}/{name}")
