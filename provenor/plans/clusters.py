"""Clustering of candidates and the enriched ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenor import constants as K
from provenor.functions import norm_key, zero_if_null
from provenor.operators import ml
from provenor.operators.aggregates import cluster_profile, dedup

# --- fixed values: the model's four features ---
FEATURES = ["abs_log2FC", "log_weighted_degree", "avg_combined_score", "log_num_interactions"]
MEANS = {
    "abs_log2FC": "avg_abs_log2FC", "weighted_degree_protein": "avg_weighted_degree", "avg_combined_score": "avg_combined_score",
    "num_interactions_in_deg_network": "avg_num_interactions", "final_score": "avg_final_score",
}


def ml_features(candidates: DataFrame) -> DataFrame:
    """One row per protein with absent values set to 0 and hub-heavy features as logs."""
    one = dedup(candidates, ["protein_id"], [F.col("final_score").desc(), F.col("gene_name").asc(), F.col("gene_id_base").asc()])
    filled = one.withColumns({
        "log2FC": F.col("log2FC").cast("double"),
        "abs_log2FC": F.abs(zero_if_null("log2FC", "double")),
        "weighted_degree_protein": zero_if_null("weighted_degree_protein", "double"),
        "avg_combined_score": zero_if_null("avg_combined_score", "double"),
        "num_interactions_in_deg_network": zero_if_null("num_interactions_in_deg_network", "bigint"),
        "final_score": F.col("final_score").cast("double"),
    })
    return filled.withColumns({
        "log_weighted_degree": F.log1p("weighted_degree_protein"), "log_num_interactions": F.log1p("num_interactions_in_deg_network"),
    }).select(*K.POINT_COLUMNS)


def cluster_candidates(features: DataFrame, seed: int = K.ML_SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(silhouette per k, clustered candidates, cluster summary)."""
    stored = ml.stored_features(features, FEATURES, features.columns)
    scores = ml.select_k(stored, seed=seed)
    points = ml.cluster(stored, ml.best_k(scores), seed).select(*K.POINT_COLUMNS, "cluster_id")
    summary = cluster_profile(points, "cluster_id", MEANS, "abs_log2FC", "weighted_degree_protein").orderBy(F.desc("avg_final_score"))
    return scores, points.join(summary.select("cluster_id", "candidate_group"), "cluster_id", "left"), summary


def enrich_ranking(top: DataFrame, support: DataFrame, clusters: DataFrame) -> DataFrame:
    """Ranking with support by normalised name and cluster by protein; columns of ``top`` win."""
    def extra(df: DataFrame, key: str) -> DataFrame:
        return df.select(key, *[c for c in df.columns if c != key and c not in top.columns])

    named = top.withColumn("gene_name_norm", norm_key("gene_name"))
    out = named.join(extra(support, "gene_name_norm"), "gene_name_norm", "left").drop("gene_name_norm")
    return out.join(extra(clusters, "protein_id"), "protein_id", "left")


def enriched_targets(top: DataFrame, support: DataFrame, clusters: DataFrame) -> DataFrame:
    """The final ranking table."""
    joined = enrich_ranking(
        top, support.select("gene_name_norm", *K.ENRICHED_SUPPORT), clusters.select("protein_id", "cluster_id", "candidate_group")
    )
    return joined.select(*top.columns, *K.ENRICHED_SUPPORT, "cluster_id", "candidate_group")
