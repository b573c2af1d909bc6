"""From QC-passed expression to ranked candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenor import constants as K
from provenor.functions import log2p1
from provenor.operators.aggregates import any_flag
from provenor.operators.graph import interaction_features
from provenor.operators.joins import assemble, keep_members
from provenor.operators.scoring import rank_candidates, score_candidates, top_candidates
from provenor.operators.stats import call_diff, two_group_test


def passing_samples(qc: DataFrame) -> DataFrame:
    """Samples none of whose files is an outlier."""
    bad = F.col("is_outlier_library_size") | F.col("is_outlier_detected_genes")
    status = any_flag(qc, ["sample_id", "case_id", "sample_group"], bad)
    return status.where(~F.col("has_flag")).select("sample_id", "case_id", "sample_group")


def qc_pass_expression(counts: DataFrame, qc: DataFrame) -> DataFrame:
    """Expression of the samples that pass QC, with its log."""
    kept = keep_members(counts, passing_samples(qc), ["sample_id", "case_id", "sample_group"])
    return kept.select(
        "sample_id", "case_id", "sample_group", "gene_id_base", "gene_name",
        F.col("tpm").cast("double").alias("tpm"), log2p1(F.col("tpm").cast("double")).alias("log2_tpm"),
    )


def difference(
    expr: DataFrame, case: str = "tumor", control: str = "normal", min_effect: float = K.MIN_EFFECT, alpha: float = K.MAX_P
) -> DataFrame:
    """Per gene: group means, log fold change, p-value, direction and whether it is different.

    A group label counts when it contains the group's name.
    """
    text = F.lower(F.trim("sample_group"))
    label = F.when(text.contains(case), case).when(text.contains(control), control)
    rows = expr.select(
        "gene_id_base", "gene_name", F.col("tpm").cast("double").alias("tpm"),
        F.col("log2_tpm").cast("double").alias("log2_tpm"), label.alias("__group"),
    )
    tested = two_group_test(rows, ["gene_id_base", "gene_name"], "__group", "tpm", "log2_tpm", case, control)
    return call_diff(tested, min_effect=min_effect, alpha=alpha).select(
        "gene_id_base", "gene_name",
        F.col("mean_value_case").alias("mean_tumor"), F.col("mean_value_control").alias("mean_normal"),
        F.col("mean_log_case").alias("mean_log2_tpm_tumor"), F.col("mean_log_control").alias("mean_log2_tpm_normal"),
        F.col("effect").alias("log2FC"), "p_value", F.col("direction").alias("deg_direction"), F.col("is_different").alias("is_deg"),
    )


def network_features(mapped: DataFrame, edges: DataFrame, nodes: DataFrame, parts: int = 0) -> DataFrame:
    """Degree and neighbourhood features of the mapped proteins.

    ``mapped`` and ``edges`` are read several times and should be stored tables.
    """
    ids = mapped.select("protein_id").where(F.col("protein_id").isNotNull()).distinct()
    found = interaction_features(
        edges, ids, "protein_id", "protein_id_src", "protein_id_dst", "combined_score_protein", "edge_weight_protein", parts=parts
    ).select(
        "protein_id", F.col("n_interactions").alias("num_interactions_in_deg_network"),
        F.col("avg_score").alias("avg_combined_score"), F.col("max_score").cast("double").alias("max_combined_score"),
        F.col("n_high").alias("num_high_confidence_edges"),
    )
    named = nodes.select("protein_id", "ensp_id", "protein_name", "gene_name", "degree_protein", "weighted_degree_protein")
    return assemble(ids, "protein_id", [named, found], {
        "degree_protein": 0, "weighted_degree_protein": 0.0, "num_interactions_in_deg_network": 0,
        "avg_combined_score": 0.0, "max_combined_score": 0.0, "num_high_confidence_edges": 0,
    })


def scored_candidates(mapped: DataFrame, features: DataFrame) -> DataFrame:
    return score_candidates(
        mapped.select("gene_id_base", "gene_name", "protein_id", "ensp_id", F.col("log2FC").cast("double"), F.col("p_value").cast("double"), "deg_direction"),
        features,
    )


def candidate_features(mapped: DataFrame, features: DataFrame) -> DataFrame:
    """All candidates, ranked."""
    return rank_candidates(scored_candidates(mapped, features)).select(*K.CANDIDATE_COLUMNS)


def top_candidate_targets(mapped: DataFrame, features: DataFrame, n: int = K.TOP_N) -> DataFrame:
    """The best ``n`` candidates."""
    return top_candidates(scored_candidates(mapped, features), n).select(*K.CANDIDATE_COLUMNS)
