"""Group moments, the two-group difference test and its call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenor import constants as K
from provenor.functions import two_sided_p
from provenor.operators.shape import direction, pivot_groups, safe_flag


def group_moments(
    df: DataFrame, entity: Sequence[str], group: str, value: str, log_value: str, sample: str
) -> DataFrame:
    """Means, sample variance, number of values and of distinct samples per entity and group."""
    return df.groupBy(*entity, group).agg(
        F.avg(value).alias("mean_value"),
        F.avg(log_value).alias("mean_log"),
        F.var_samp(log_value).alias("var_log"),
        F.count(log_value).alias("n_values"),
        F.count_distinct(sample).alias("n_samples"),
    )


def two_group_test(
    df: DataFrame, entity: Sequence[str], group: str, value: str, log_value: str, case: object, control: object
) -> DataFrame:
    """Difference of log means with a normal-approximation p-value.

    Entities without both groups are left out. The statistic needs two values per
    group and a positive standard error, otherwise statistic and p are null.
    The moments merge map-side, so a dominant entity costs no extra shuffle.
    """
    used = df.where(F.col(group).isin(case, control))
    moments = used.groupBy(*entity, group).agg(
        F.avg(value).alias("mean_value"),
        F.avg(log_value).alias("mean_log"),
        F.var_samp(log_value).alias("var_log"),
        F.count(log_value).alias("n_values"),
    )
    wide = pivot_groups(
        moments, entity, group, {case: "case", control: "control"}, ["mean_value", "mean_log", "var_log", "n_values"]
    ).where("mean_log_case IS NOT NULL AND mean_log_control IS NOT NULL")
    error = F.sqrt(F.col("var_log_case") / F.col("n_values_case") + F.col("var_log_control") / F.col("n_values_control"))
    usable = (F.least("n_values_case", "n_values_control") >= 2) & (F.col("std_error") > 0)
    return (
        wide.withColumn("effect", F.col("mean_log_case") - F.col("mean_log_control"))
        .withColumn("std_error", error)
        .withColumn("t_stat", F.when(usable, F.try_divide("effect", "std_error")))
        .withColumn("p_value", two_sided_p(F.col("t_stat")))
    )


def call_diff(df: DataFrame, effect: str = "effect", p: str = "p_value", min_effect: float = K.MIN_EFFECT, alpha: float = K.MAX_P) -> DataFrame:
    """Direction label and the flag abs(effect) >= min_effect and p < alpha."""
    e = F.col(effect)
    return df.withColumns({
        "direction": direction(e),
        "is_different": safe_flag((F.abs(e) >= min_effect) & (F.col(p) < alpha)),
    })


def check_groups(df: DataFrame, group: str, sample: str, case: object, control: object, at_least: int = 2) -> None:
    """Error unless both groups hold enough distinct samples; reads two counts."""
    counts = df.where(F.col(group).isin(case, control)).groupBy(group).agg(F.count_distinct(sample).alias("n"))
    found = {r[group]: r["n"] for r in counts.limit(2).collect()}
    short = [str(g) for g in (case, control) if found.get(g, 0) < at_least]
    if short:
        raise ValueError(f"fewer than {at_least} samples in group: {', '.join(short)}")
