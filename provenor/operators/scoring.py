"""Scaling, composite scores and the candidate ranking."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenor import constants as K
from provenor.functions import blend
from provenor.operators.joins import assemble, with_stats
from provenor.operators.sorting import global_rank, top_k
from provenor.operators.windows import best_by
from provenor.session import materialise


def minmax(df: DataFrame, cols: Mapping[str, str]) -> DataFrame:
    """``{column: out}`` scaled to 0..1 over all rows; a constant or empty column gives 0."""
    ends = df.agg(*[f(c).cast("double").alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])

    def scaled(c: str) -> Column:
        lo, hi = F.col(f"__stats.lo_{c}"), F.col(f"__stats.hi_{c}")
        return F.when(lo < hi, (F.col(c) - lo) / (hi - lo)).otherwise(F.lit(0.0))

    return with_stats(df, ends).withColumns({out: scaled(c) for c, out in cols.items()}).drop("__stats")


def composite(df: DataFrame, weights: Mapping[str, float], out: str, absent: Column | None = None) -> DataFrame:
    """Weighted sum; null where ``absent`` holds."""
    score = blend(weights)
    return df.withColumn(out, score if absent is None else F.when(~absent, score))


def support_level(score: Column, found: Column) -> Column:
    """Level of a support score; its own level where nothing was found."""
    label = F.when(~found, K.SUPPORT_NOT_FOUND)
    for name, least in K.SUPPORT_BANDS:
        label = label.when(score >= least, name)
    return label.otherwise(K.SUPPORT_FLOOR)


def score_candidates(evidence: DataFrame, features: DataFrame) -> DataFrame:
    """Best evidence per protein with scaled component scores and the final score.

    ``evidence`` has gene_id_base, gene_name, protein_id, ensp_id, log2FC, p_value
    and deg_direction; ``features`` the network columns by protein_id.
    """
    joined = assemble(
        evidence.where(F.col("gene_name").isNotNull() & F.col("protein_id").isNotNull()),
        "protein_id",
        [features.select(
            "protein_id", "protein_name",
            F.col("degree_protein").cast("bigint"), F.col("weighted_degree_protein").cast("double"),
            F.col("num_interactions_in_deg_network").cast("bigint"), F.col("avg_combined_score").cast("double"),
        )],
        {"degree_protein": 0, "weighted_degree_protein": 0.0, "num_interactions_in_deg_network": 0, "avg_combined_score": 0.0},
    ).withColumn("abs_log2FC", F.abs("log2FC"))
    best = best_by(joined, ["protein_id"], [
        F.col("abs_log2FC").desc(), F.col("p_value").asc_nulls_last(), F.col("gene_name").asc(), F.col("gene_id_base").asc(),
    ])
    # stored once: the extremes and the rows are two passes over it, not over everything upstream
    scaled = minmax(materialise(best, "candidates"), {
        "abs_log2FC": "expression_score",
        "weighted_degree_protein": "protein_network_score",
        "avg_combined_score": "string_confidence_score",
    })
    return composite(scaled, K.RANK_WEIGHTS, "final_score")


def rank_order() -> list[Column]:
    """Rank order of candidates, completed by the unique protein id.

    Scores are compared at fixed precision, so that the order in which a
    distributed sum happens to run never decides between equal candidates.
    """
    return [
        F.round("final_score", 12).desc(), F.round("abs_log2FC", 12).desc(), F.round("weighted_degree_protein", 9).desc(),
        F.col("gene_name").asc(), F.col("protein_id").asc(),
    ]


def rank_candidates(scored: DataFrame) -> DataFrame:
    """All candidates with their rank."""
    return global_rank(scored, rank_order())


def top_candidates(scored: DataFrame, n: int = K.TOP_N) -> DataFrame:
    """First ``n`` candidates; needs no full ranking."""
    return top_k(scored, rank_order(), n)
