"""Window-shaped operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenor import constants as K
from provenor.operators.ordering import number_rows, stored_input, with_previous
from provenor.operators.sorting import n_per_group


def best_by(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key; Spark keeps one row per key and task before it shuffles."""
    return n_per_group(df, key, order, 1)


def canonical_edges(
    edges: DataFrame, src: str, dst: str, pairs: Sequence[tuple[str, str]], score: str, weight: str, tie: tuple[str, str]
) -> DataFrame:
    """Undirected edges: ends in order, self loops and open ends gone, one row per pair.

    ``pairs`` are (src, dst) attribute columns that swap along. Carries the best
    score and weight, the number of rows, and the attributes of the best row
    (highest score, then smallest ``tie``), all as mergeable aggregates.
    """
    flip = F.col(src) > F.col(dst)
    ends = [(src, dst), *pairs]
    cols = [F.when(flip, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in ends]
    cols += [F.when(flip, F.col(a)).otherwise(F.col(b)).alias(b) for a, b in ends]
    ordered = edges.where(F.col(src) != F.col(dst)).select(*cols, score, weight)
    attrs = [c for pair in pairs for c in pair]
    rank = F.struct(F.col(score).isNull(), -F.col(score), F.col(tie[0]), F.col(tie[1]))
    best = F.min_by(F.struct(*attrs), rank)
    return (
        ordered.groupBy(src, dst)
        .agg(best.alias("__best"), F.max(score).alias(f"max_{score}"), F.max(weight).alias(f"max_{weight}"), F.count(F.lit(1)).alias("edge_count"))
        .select(src, dst, "__best.*", f"max_{score}", f"max_{weight}", "edge_count")
    )


def within_percentile(
    df: DataFrame, part: Sequence[str], value: str, tie: str, out: str = "percentile", top: float = K.TOP_QUARTILE,
    stored: bool = False,
) -> DataFrame:
    """Relative rank 0..1 within each part; a lone row gets 1.0; flag for the top quartile.

    ``tie`` is unique within a part, so relative rank is (position - 1) / (n - 1).
    """
    rows = stored_input(df, stored)
    placed = number_rows(rows, [F.col(value).asc(), F.col(tie).asc()], part, "__pos", "n_in_part")
    pct = F.when(F.col("n_in_part") <= 1, F.lit(1.0)).otherwise((F.col("__pos") - 1) / F.nullif(F.col("n_in_part") - 1, F.lit(0)))
    return placed.withColumn(out, pct).drop("__pos").withColumn("is_top_quartile", F.col(out) >= top)


def support_rank(df: DataFrame, score: str, rank: str, out: str = "support_rank", stored: bool = False) -> DataFrame:
    """Rank by score (compared at 12 decimals), missing scores last, then by the first rank."""
    return number_rows(stored_input(df, stored), [F.round(score, 12).desc_nulls_last(), F.col(rank).asc()], position=out)


def order_violations(df: DataFrame, rank: str, value: str, tie: str) -> DataFrame:
    """One row: how often the value rises, or the rank fails to rise, along the ranking."""
    along = with_previous(df.select(rank, value, tie), [F.col(rank).asc(), F.col(tie).asc()], [rank, value])
    return along.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(value) > F.col(f"prev_{value}")).alias("value_rises"),
        F.count_if(F.col(rank) <= F.col(f"prev_{rank}")).alias("rank_repeats"),
    )


def pack_context(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], length: str, budget: int = K.CONTEXT_BUDGET
) -> DataFrame:
    """Leading rows per key whose running length fits the budget; the first row always stays.

    Packing stops at the first row that does not fit, it never skips ahead.
    """
    run = number_rows(df, order, keys, "place", running={"used": length})
    # lengths are not negative, so the rows that fit are exactly those before the first overflow
    return run.where((F.col("place") == 1) | (F.col("used") <= budget))
