"""Projections and reshaping."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenor import constants as K
from provenor.functions import not_blank, zero_if_null
from provenor.operators.sorting import n_per_group, top_k


def project_typed(df: DataFrame, spec: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``{out: (column, type)}``; text that does not parse becomes null."""
    return df.select(*[F.col(f"`{c}`").try_cast(t).alias(out) for out, (c, t) in spec.items()])


def drop_rename(df: DataFrame, drop: Sequence[str], rename: Mapping[str, str]) -> DataFrame:
    """Drop and rename columns that must exist; the others stay as they are."""
    absent = sorted({*drop, *rename} - set(df.columns))
    if absent:
        raise ValueError(f"columns not found: {', '.join(absent)}")
    return df.drop(*drop).withColumnsRenamed(dict(rename))


def band(df: DataFrame, out: str, rules: Sequence[tuple[Column, str]], default: str) -> DataFrame:
    """Label of the first rule that holds; a null condition does not hold."""
    label = None
    for cond, name in rules:
        label = F.when(cond, name) if label is None else label.when(cond, name)
    return df.withColumn(out, label.otherwise(default))


def confidence(first: Column, second: Column) -> Column:
    """high / medium / low for both, one or none of two values present."""
    present = first.isNotNull().cast("int") + second.isNotNull().cast("int")
    return F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), present + 1)


def direction(effect: Column) -> Column:
    return (
        F.when(effect > 0, K.DIRECTION_UP).when(effect < 0, K.DIRECTION_DOWN).otherwise(K.DIRECTION_NONE)
    )


def fill_defaults(df: DataFrame, spec: Mapping[str, str]) -> DataFrame:
    """``{column: type}``: cast, and zero where null."""
    return df.withColumns({c: zero_if_null(c, t) for c, t in spec.items()})


def safe_flag(cond: Column) -> Column:
    """A condition that is false instead of null."""
    return F.coalesce(cond, F.lit(False))


def with_literals(df: DataFrame, **values: object) -> DataFrame:
    return df.withColumns({n: F.lit(v) for n, v in values.items()})


def nest(df: DataFrame, sections: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """One struct per section: ``{section: {field: column}}``."""
    return df.select(*[
        F.struct(*[c.alias(n) for n, c in fields.items()]).alias(name) for name, fields in sections.items()
    ])


def select_existing(df: DataFrame, cols: Sequence[str], limit: int | None = None) -> DataFrame:
    """The listed columns that exist, in the listed order."""
    kept = df.select(*[F.col(f"`{c}`") for c in cols if c in df.columns])
    return kept if limit is None else kept.limit(limit)


def wide_groups_to_long(
    df: DataFrame, key: str, attrs: Sequence[str], pattern: str = r"samples\.(\d+)\.{attr}", id_attr: str | None = None
) -> DataFrame:
    """Numbered column groups to one row per number, in one pass.

    ``{attr}`` in ``pattern`` stands for the attribute; a group exists where its
    id column does; attributes it lacks are null and rows with a blank id go.
    """
    id_attr = id_attr or attrs[0]
    found: dict[str, dict[int, str]] = {a: {} for a in attrs}
    for a in attrs:
        rx = re.compile(pattern.replace("{attr}", re.escape(a)) + "$")
        for c in df.columns:
            m = rx.match(c)
            if m:
                found[a][int(m.group(1))] = c
    groups = [
        F.struct(*[
            (F.col(f"`{found[a][n]}`").cast("string") if n in found[a] else F.lit(None).cast("string")).alias(a)
            for a in attrs
        ])
        for n in sorted(found[id_attr])
    ]
    if not groups:
        return df.select(key, *[F.lit(None).cast("string").alias(a) for a in attrs]).where(F.lit(False))
    return df.select(key, F.inline(F.array(*groups))).where(not_blank(id_attr))


def melt(df: DataFrame, keys: Sequence[str], cols: Sequence[str], name: str, value: str, as_type: str = "double") -> DataFrame:
    """Columns to (name, value) rows; values that do not parse are dropped."""
    typed = df.select(*keys, *[F.col(f"`{c}`").cast("string").alias(c) for c in cols])
    long = typed.unpivot(list(keys), [F.col(f"`{c}`") for c in cols], name, value)
    return long.withColumn(value, F.col(value).try_cast(as_type)).where(F.col(value).isNotNull())


def pivot_groups(
    df: DataFrame, keys: Sequence[str], group: str, groups: Mapping[object, str], metrics: Sequence[str]
) -> DataFrame:
    """Group rows to columns ``metric_suffix`` with ``groups = {value: suffix}``."""
    return df.groupBy(*keys).agg(*[
        F.max(F.when(F.col(group) == F.lit(g), F.col(m))).alias(f"{m}_{suffix}")
        for m in metrics for g, suffix in groups.items()
    ])


def heat_map(
    df: DataFrame,
    row: str,
    col: str,
    group: str,
    value: str,
    groups: Sequence[str],
    row_order: Sequence[Column],
    rows: DataFrame,
    n_rows: int = K.HEATMAP_ROWS,
    n_cols: int = K.HEATMAP_SAMPLES,
) -> DataFrame:
    """Matrix as one row per row label with its cells in column order.

    The first ``n_rows`` labels of ``rows`` by ``row_order`` and the first
    ``n_cols`` column labels of each of the ``groups``, in the order given, form
    the frame; absent cells are null. At most n_rows x groups x n_cols cells are
    ever assembled. ``cell_no`` is the place of a cell in its row.
    """
    df = df.where(F.col(group).isin(*groups))
    labels = top_k(rows, row_order, n_rows).select(row, F.col("rank").alias("row_no"))
    columns = n_per_group(df.select(group, col).distinct(), [group], [F.col(col)], n_cols, number="col_no")
    cells = (
        df.select(row, col, value).join(labels.select(row), row).join(columns.select(col).distinct(), col)
        .groupBy(row, col).agg(F.max(value).alias(value))
        .groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(col, value))).alias("__cells"))
    )
    place = F.array_position(F.array(*map(F.lit, groups)), F.col(group)).alias("group_no")
    frame = columns.agg(F.sort_array(F.collect_list(F.struct(place, "col_no", group, col))).alias("c")).scalar()
    return labels.join(cells, row, "left").withColumn("__frame", frame).select(
        "row_no", row,
        F.transform(
            "__frame",
            lambda c, i: F.struct((i + 1).alias("cell_no"), c[group].alias(group), c[col].alias(col), F.try_element_at("__cells", c[col]).alias("cell")),
        ).alias("cells"),
    )


def explode_components(df: DataFrame, keep: Sequence[str], weights: Mapping[str, tuple[str, float]], digits: int = 4) -> DataFrame:
    """One row per score component: ``weights = {name: (column, weight)}``; null counts as 0."""
    parts = []
    for no, (name, (column, weight)) in enumerate(weights.items(), 1):
        raw = zero_if_null(column, "double")
        parts.append(F.struct(
            F.lit(no).alias("component_no"), F.lit(name).alias("name"), raw.alias("raw_score"),
            F.lit(float(weight)).alias("weight"), F.round(raw * weight, digits).alias("weighted_score"),
        ))
    return df.select(*keep, F.inline(F.array(*parts)))
