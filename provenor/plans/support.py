"""Support of the top candidates in an external cohort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenor import constants as K
from provenor.functions import blend, log2p1, norm_key, not_blank
from provenor.operators.aggregates import mean_replicates, shares, support_stats
from provenor.operators.joins import header_members, keep_members
from provenor.operators.scoring import support_level
from provenor.operators.shape import melt
from provenor.operators.sorting import order_levels
from provenor.operators.windows import support_rank, within_percentile

STAT_NAMES = {
    "n_available": "geo_num_samples_available", "n_total": "geo_total_samples", "coverage_rate": "geo_coverage_rate",
    "mean_value": "geo_mean_expression", "median_value": "geo_median_expression",
    "mean_percentile": "geo_mean_percentile", "top_quartile_rate": "geo_top_quartile_rate",
}
RESULT_COLUMNS = [
    "rank", "gene_name", "gene_name_norm", "protein_id", "ensp_id", "final_score", "geo_match_status", *STAT_NAMES.values(),
    "geo_support_score", "geo_support_level", "geo_validation_mode",
]


def cohort_values(
    top: DataFrame, wide: DataFrame, samples: DataFrame, gene: str = "gene_name", already_log: bool = True, drop: tuple[str, ...] = ()
) -> DataFrame:
    """One value per candidate gene and matched sample.

    The matrix is cut to candidate genes before it is unpivoted, and replicates
    of a gene are averaged.
    """
    keys = top.select(norm_key(gene).alias("gene_name_norm")).distinct()
    sample_cols = [c for c in wide.columns if c != gene and c not in drop]
    cut = keep_members(wide.withColumn("gene_name_norm", norm_key(gene)).where(not_blank("gene_name_norm")), keys, ["gene_name_norm"])
    long = melt(cut, ["gene_name_norm"], sample_cols, "sample_id", "value").withColumn("sample_id", norm_key("sample_id"))
    kept = keep_members(long, samples, ["sample_id"], salts=8)
    used = kept if already_log else kept.withColumn("value", log2p1("value"))
    return mean_replicates(used, ["gene_name_norm", "sample_id"], "value")


def cohort_stats(values: DataFrame, total: Column) -> DataFrame:
    """Support statistics per gene; percentiles are taken within each sample."""
    placed = within_percentile(values, ["sample_id"], "value", "gene_name_norm")
    return support_stats(placed, "gene_name_norm", "sample_id", "value", "percentile", total).withColumnsRenamed(STAT_NAMES)


def cohort_support(top: DataFrame, wide: DataFrame, meta: DataFrame, meta_id: str = "Array", already_log: bool = True) -> DataFrame:
    """Match status, statistics, support score and level of every top candidate."""
    samples = header_members(wide, meta, ["gene_name"], meta_id)
    total = samples.agg(F.count(F.lit(1)).alias("n")).scalar()
    stats = cohort_stats(cohort_values(top, wide, samples, already_log=already_log), total)
    return attach_support(top, stats, total)


def attach_support(top: DataFrame, stats: DataFrame, total: Column) -> DataFrame:
    base = top.select(
        F.col("rank").cast("int").alias("rank"), "gene_name", norm_key("gene_name").alias("gene_name_norm"), "protein_id", "ensp_id",
        F.col("final_score").cast("double").alias("final_score"),
    ).where(not_blank("gene_name_norm"))
    joined = base.join(stats, "gene_name_norm", "left")
    found = F.col("geo_num_samples_available").isNotNull()
    return joined.withColumns({
        "geo_match_status": F.when(found, K.SUPPORT_FOUND).otherwise(K.SUPPORT_NOT_FOUND),
        "geo_total_samples": F.coalesce(F.col("geo_total_samples"), total.cast("bigint")),
        "geo_support_score": F.when(found, blend(K.SUPPORT_WEIGHTS)),
        "geo_validation_mode": F.lit(K.SUPPORT_MODE),
    }).withColumn("geo_support_level", support_level(F.col("geo_support_score"), found)).select(*RESULT_COLUMNS)


def support_summary(result: DataFrame) -> DataFrame:
    """Candidates per level, from strong to not found."""
    counted = shares(result, "geo_support_level", "candidate_count", "candidate_percentage")
    return order_levels(counted, "geo_support_level", K.SUPPORT_LEVELS).drop("level_no")


def supported_top_candidates(result: DataFrame, stored: bool = False) -> DataFrame:
    """Candidates by support score, those without one last."""
    return support_rank(result, "geo_support_score", "rank", "geo_support_rank", stored).select(*K.SUPPORTED_COLUMNS)
