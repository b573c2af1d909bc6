"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenor import constants as K
from provenor.functions import not_blank, norm_key
from provenor.operators.sorting import page


def keep_matching(df: DataFrame, col: str, pattern: str) -> DataFrame:
    return df.where(F.col(col).rlike(pattern))


def filter_class(df: DataFrame, class_col: str, value: str, flag: str) -> DataFrame:
    """Rows of one class whose flag is false; the flag column is dropped."""
    return df.where((F.col(class_col) == value) & ~F.col(flag)).drop(flag)


def keep_present(df: DataFrame, *cols: str) -> DataFrame:
    """Rows where none of the columns is null or blank."""
    for c in cols:
        df = df.where(not_blank(c))
    return df


def filter_in(df: DataFrame, col: str, values: Sequence[str]) -> DataFrame:
    """Rows whose trimmed, lower-cased value is one of a short list."""
    return df.where(F.lower(F.trim(F.col(col))).isin([v.lower() for v in values]))


def min_weight(df: DataFrame, col: str, threshold: float = K.EDGE_MIN_WEIGHT) -> DataFrame:
    return df.where(F.col(col) >= threshold)


def _text(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def candidate_filter(
    search: str | None = None,
    search_cols: Sequence[str] = ("gene_name", "protein_id", "ensp_id"),
    equals: dict[str, str | None] | None = None,
    contains: dict[str, str | None] | None = None,
    cluster: tuple[str, int] | None = None,
    min_score: tuple[str, float] | None = None,
) -> Column:
    """All given criteria: substring over several columns, case-blind equality, case-blind substring."""
    cond = F.lit(True)
    if search:
        hits = [F.contains(F.upper(_text(c)), F.lit(search.upper())) for c in search_cols]
        some = hits[0]
        for h in hits[1:]:
            some = some | h
        cond = cond & some
    for c, v in (equals or {}).items():
        if v:
            cond = cond & (F.lower(_text(c)) == v.lower())
    for c, v in (contains or {}).items():
        if v:
            cond = cond & F.contains(F.lower(_text(c)), F.lit(v.lower()))
    if cluster is not None:
        cond = cond & (F.col(cluster[0]) == cluster[1])
    if min_score is not None:
        cond = cond & (F.col(min_score[0]) >= min_score[1])
    return cond


def search_targets(
    df: DataFrame, rank: str, limit: int, offset: int = 0, with_total: bool = True, tie: str | None = None, **criteria
) -> DataFrame:
    """One page of the matching rows in rank order, missing ranks last, with the total; deep pages need a unique rank or ``tie``."""
    hits = df.where(F.coalesce(candidate_filter(**criteria), F.lit(False)))
    order = [F.col(rank).asc_nulls_last()] + ([F.col(tie).asc()] if tie else [])
    shown = page(hits, order, limit, offset)
    if not with_total:
        return shown
    return shown.withColumn("total", hits.agg(F.count(F.lit(1)).alias("n")).scalar())


def search_total(df: DataFrame, **criteria) -> DataFrame:
    return df.where(F.coalesce(candidate_filter(**criteria), F.lit(False))).agg(F.count(F.lit(1)).alias("total"))


def lookup(df: DataFrame, token: str, cols: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row, in the given order, where any of the identifiers equals the token."""
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.coalesce(F.upper(F.col(c).cast("string")) == token.upper(), F.lit(False))
    return df.where(cond).orderBy(*order).limit(1)


def _finite(col: str) -> Column:
    v = F.col(col).cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def plot_ready(
    df: DataFrame,
    numbers: Sequence[str],
    view: str,
    flag: str,
    direction: str,
    rank: str,
    effect: str,
    tie: str,
    limit: int = K.PLOT_LIMIT,
) -> DataFrame:
    """Drawable points of a view: ``up``, ``down``, ``not``, or ``all`` (best ranks, then largest effects)."""
    cond = F.lit(True)
    for c in numbers:
        cond = cond & _finite(c)
    drawn = df.where(cond)
    significant = F.coalesce(F.col(flag), F.lit(False))
    if view == "up":
        return drawn.where(significant & (F.col(direction) == K.DIRECTION_UP))
    if view == "down":
        return drawn.where(significant & (F.col(direction) == K.DIRECTION_DOWN))
    if view == "not":
        return drawn.where(~significant)
    if view != "all":
        raise ValueError(f"unknown view: {view}")
    return drawn.orderBy(F.col(rank).asc_nulls_last(), F.abs(F.col(effect)).desc(), F.col(tie)).limit(limit)


def matches_key(df: DataFrame, col: str, token: str) -> DataFrame:
    return df.where(norm_key(col) == token.strip().upper())
