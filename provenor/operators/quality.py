"""Data-quality checks: schema checks without a job, row checks as one result table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def require_columns(df: DataFrame, cols: Sequence[str], name: str = "table") -> None:
    absent = sorted(set(cols) - set(df.columns))
    if absent:
        raise ValueError(f"{name} lacks columns: {', '.join(absent)}")


def require_schema(df: DataFrame, cols: Sequence[str], types: Mapping[str, str] | None = None, name: str = "table") -> None:
    """Exact column order, and the given types."""
    if df.columns != list(cols):
        raise ValueError(f"{name} has columns {df.columns}, expected {list(cols)}")
    found = dict(df.dtypes)
    wrong = [f"{c} is {found[c]}, expected {t}" for c, t in (types or {}).items() if found[c] != t]
    if wrong:
        raise ValueError(f"{name}: {'; '.join(wrong)}")


def dup_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def _counts(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Conditional counts of all checks in one pass, as rows (check, n_bad)."""
    names = list(checks)
    one = df.agg(*[F.count_if(F.coalesce(checks[n], F.lit(False))).alias(f"c{i}") for i, n in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"c{i}").alias("n_bad")) for i, n in enumerate(names)])
    return one.select(F.inline(rows))


def null_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Null or NaN values per column, and rows with any of them."""
    types = dict(df.dtypes)

    def bad(c: str) -> Column:
        return (F.col(c).isNull() | F.isnan(c)) if types[c] in ("double", "float") else F.col(c).isNull()

    checks = {c: bad(c) for c in cols}
    return _counts(df, {**checks, "any": reduce(lambda a, b: a | b, checks.values())})


def out_of_range(df: DataFrame, rules: Mapping[str, tuple[float | None, float | None]], null_is_bad: bool = False) -> DataFrame:
    """Values below or above their inclusive limits, per column."""
    checks = {}
    for c, (low, high) in rules.items():
        cond = F.lit(False)
        if low is not None:
            cond = cond | F.coalesce(F.col(c) < low, F.lit(False))
        if high is not None:
            cond = cond | F.coalesce(F.col(c) > high, F.lit(False))
        checks[c] = cond | F.col(c).isNull() if null_is_bad else cond
    return _counts(df, checks)


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break each rule; a rule is a condition that must hold and null breaks it."""
    return _counts(df, {n: ~F.coalesce(c, F.lit(False)) for n, c in rules.items()})


def orphans(df: DataFrame, ref: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``df`` that ``ref`` lacks."""
    return df.select(key).distinct().join(ref.select(key), key, "left_anti")


def row_counts(pairs: Mapping[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Rows before and after each step, whether they agree and whether any are left."""
    parts = []
    for name, (before, after) in pairs.items():
        b = before.agg(F.count(F.lit(1)).alias("n")).scalar()
        one = after.agg(F.count(F.lit(1)).alias("n_after"))
        parts.append(one.select(F.lit(name).alias("check"), b.alias("n_before"), "n_after"))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.withColumns({"preserved": F.col("n_before") == F.col("n_after"), "non_empty": F.col("n_after") > 0})


def rank_gaps(df: DataFrame, rank: str) -> DataFrame:
    """Whether ranks run from 1 to the row count without gaps or repeats."""
    one = df.agg(
        F.min(rank).cast("bigint").alias("min_rank"), F.max(rank).cast("bigint").alias("max_rank"),
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(rank).alias("n_ranks"),
    )
    whole = (F.col("min_rank") == 1) & (F.col("max_rank") == F.col("n_rows")) & (F.col("n_ranks") == F.col("n_rows"))
    return one.withColumn("contiguous", F.coalesce(whole, F.lit(False)))


def reconcile_totals(df: DataFrame, count: str, percent: str, expected: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Whether category counts add up to the rows of ``expected`` and percentages to 100."""
    total = expected.agg(F.count(F.lit(1)).alias("n")).scalar()
    one = df.agg(F.sum(count).cast("bigint").alias("n_summary"), F.sum(percent).alias("percent_total"))
    return one.withColumn("n_expected", total).withColumns({
        "counts_agree": F.col("n_summary") == F.col("n_expected"),
        "percent_agrees": F.abs(F.col("percent_total") - 100.0) <= tolerance,
    })


def leaks(out: DataFrame, excluded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``out`` whose key was excluded: one count."""
    return out.join(excluded.select(*keys).distinct(), list(keys), "left_semi").agg(F.count(F.lit(1)).alias("n_leaked"))


def assert_clean(result: DataFrame, name: str = "check") -> None:
    """Error that lists the failed checks of a (check, n_bad) table, which has one row per rule."""
    bad = [(r["check"], r["n_bad"]) for r in result.where("n_bad > 0").collect()]
    if bad:
        raise AssertionError(f"{name}: " + ", ".join(f"{c}={n}" for c, n in bad))


def assert_none(found: DataFrame, name: str) -> None:
    """Error when a check frame has any row; shows one of them."""
    row = found.limit(1).first()
    if row is not None:
        raise AssertionError(f"{name}: {row.asDict()}")


def verify_written(spark: SparkSession, path: str, schema: StructType | None = None, rows: int | None = None) -> DataFrame:
    """Read a written table back; error when it is absent, empty, or differs from what is expected."""
    back = spark.read.parquet(path)
    if schema is not None:
        want, got = {f.name: f.dataType for f in schema}, {f.name: f.dataType for f in back.schema}
        if want != got:
            raise AssertionError(f"{path}: schema {got}, expected {want}")
    n = back.count()
    if n == 0 or (rows is not None and n != rows):
        raise AssertionError(f"{path}: {n} rows, expected {rows if rows is not None else 'some'}")
    return back
