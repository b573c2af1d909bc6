"""Sorts, limits, pages and ranks of bounded results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provenor.operators.ordering import number_rows, store_pages


def top_k(df: DataFrame, order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows with their rank; a top-k per task, then one merge of k rows each."""
    best = df.orderBy(*order).limit(k)
    return best.withColumn(rank, F.row_number().over(W.orderBy(*order)))


def global_rank(df: DataFrame, order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """Rank 1..n of all rows without a single-task sort; ``order`` ends in a unique column."""
    return number_rows(df, order, position=rank)


# a group is first cut to n rows in each of so many shares, so a hot group never meets whole
GROUP_SHARES = 32


def n_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, number: str | None = None) -> DataFrame:
    """First ``n`` rows per group; ``order`` must end in a unique column.

    A group is cut to ``n`` rows in each of its shares, then to ``n`` rows, so a
    task holds ``n`` rows per share at most, whatever ``n`` and the group. The
    share is a hash of the row, so a repeated task yields the same rows.
    """
    name = number or "__number"
    hashed = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()]
    shared = df.withColumn("__share", F.pmod(F.xxhash64(*hashed), F.lit(GROUP_SHARES)))
    per_share = F.row_number().over(W.partitionBy(*group, "__share").orderBy(*order))
    first = shared.withColumn(name, per_share).where(F.col(name) <= n).drop("__share", name)
    out = first.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col(name) <= n)
    return out if number else out.drop(name)


def level_number(col: str, levels: Sequence[str]) -> Column:
    """Position of a level in a fixed list; unknown levels come last."""
    place = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(col))
    return F.when(place > 0, place.cast("int")).otherwise(len(levels) + 1)


def order_levels(df: DataFrame, col: str, levels: Sequence[str], out: str = "level_no") -> DataFrame:
    return df.withColumn(out, level_number(col, levels)).orderBy(out)


def arg_max(df: DataFrame, value: str, tie: str) -> DataFrame:
    """The row with the largest value, ties to the smallest ``tie``; nulls lose."""
    return df.orderBy(F.col(value).desc_nulls_last(), F.col(tie).asc()).limit(1)


# so many rows of an order are kept by every task of a top-k sort at most; pages beyond are cut from stored slices
SHALLOW_ROWS = 10_000


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows offset+1 .. offset+limit of the given order, which must end in a unique column.

    A deep page is read from range slices with known row counts, so no task ever
    sorts offset + limit rows; keep ``ordering.store_pages`` to read many pages of one order.
    """
    if offset + limit <= SHALLOW_ROWS:
        return df.orderBy(*order).offset(offset).limit(limit)
    return store_pages(df, order).page(limit, offset)


def page_after(df: DataFrame, keys: Sequence[tuple[str, bool]], last: Sequence | None, limit: int) -> DataFrame:
    """The next ``limit`` rows behind the row whose key values are ``last`` (None: the first rows).

    ``keys`` lists (column, descending); the last one must be unique, and values must not be null. A filter and a top-k sort, at any depth.
    """
    order = [F.col(c).desc() if down else F.col(c).asc() for c, down in keys]
    if last is not None:
        behind, same = F.lit(False), F.lit(True)
        for (c, down), v in zip(keys, last, strict=True):
            behind = behind | (same & (F.col(c) < F.lit(v) if down else F.col(c) > F.lit(v)))
            same = same & (F.col(c) == F.lit(v))
        df = df.where(behind)
    return df.orderBy(*order).limit(limit)


def mixed_order(col: str, descending: bool = False) -> list[Column]:
    """Sort keys: numbers by value before texts by lower case, missing always last."""
    text = F.col(col).cast("string")
    gone = text.isNull() | (text == "")
    number = F.when(~gone & (F.trim(text) != ""), F.trim(text).try_cast("double"))
    word = F.when(~gone & number.isNull(), F.lower(text))
    if descending:
        return [gone.asc(), number.isNull().desc(), number.desc(), word.desc()]
    return [gone.asc(), number.isNull().asc(), number.asc(), word.asc()]


def mixed_sort(df: DataFrame, col: str, tie: str, descending: bool = False) -> DataFrame:
    return df.orderBy(*mixed_order(col, descending), F.col(tie).asc())
