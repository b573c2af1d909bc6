"""Aggregations. All of them merge partial results before the shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenor import constants as K
from provenor.functions import ratio
from provenor.operators.joins import with_stats
from provenor.operators.ordering import discrete_place, exact_quantiles, number_rows, stored_input
from provenor.operators.shape import melt
from provenor.operators.sorting import n_per_group


def sample_qc(
    df: DataFrame, keys: Sequence[str], count: str, level: str, class_col: str, class_value: str,
    level_min: float = 1.0,
) -> DataFrame:
    """Library size, detected features, median level, zero share and class count per sample.

    The median is the level at place ceil(n / 2) of a sample's n levels, exact
    for any number of them: levels are numbered in stored slices, so no task
    holds those of a whole sample. Missing levels have no place.
    """
    n, zero = F.count(F.lit(1)), F.count_if(F.col(count) == 0)
    rows = df.select(*dict.fromkeys([*keys, count, level, class_col]))
    placed = number_rows(rows.where(F.col(level).isNotNull()), [F.col(level).asc()], keys, "__pos", "__n")
    placed = placed.unionByName(rows.where(F.col(level).isNull()), allowMissingColumns=True)
    return placed.groupBy(*keys).agg(
        F.sum(F.coalesce(F.col(count), F.lit(0))).cast("bigint").alias("total_count"),
        F.count_if(F.col(count) > 0).alias("n_detected"),
        F.count_if(F.col(level) > level_min).alias("n_above_level"),
        F.max(F.when(F.col("__pos") == discrete_place("__n", 0.5), F.col(level))).cast("double").alias("median_level"),
        ratio(zero, n).alias("zero_share"),
        F.count_if(F.col(class_col) == class_value).alias("n_class"),
    )


def iqr_bounds(df: DataFrame, cols: Sequence[str], factor: float = K.IQR_FACTOR) -> DataFrame:
    """One row with lower and upper bound per column; null bounds where the IQR is not positive.

    Quartiles are the values at places ceil(n / 4) and ceil(3 n / 4) of the n values that are not null.
    """
    out = None
    for c in cols:
        placed = number_rows(df.select(c).where(F.col(c).isNotNull()), [F.col(c).asc()], position="__pos", total="__n")
        low, high = (F.max(F.when(F.col("__pos") == discrete_place("__n", p), F.col(c))).cast("double") for p in (0.25, 0.75))
        spread = F.col("__high") - F.col("__low")
        one = placed.agg(low.alias("__low"), high.alias("__high")).select(
            F.when(spread > 0, F.col("__low") - spread * factor).alias(f"{c}_lower"), F.when(spread > 0, F.col("__high") + spread * factor).alias(f"{c}_upper")
        )
        out = one if out is None else with_stats(out, one).select(*out.columns, "__stats.*")
    return out


def iqr_flags(df: DataFrame, cols: Mapping[str, str], factor: float = K.IQR_FACTOR, stored: bool = False) -> DataFrame:
    """``{column: flag}``: outside the IQR fences of all rows; never when the IQR is 0. Rows are stored first unless they come from a stored table."""
    rows = stored_input(df, stored)
    bounded = with_stats(rows, iqr_bounds(rows, list(cols), factor))
    return bounded.withColumns({
        flag: F.coalesce((F.col(c) < F.col(f"__stats.{c}_lower")) | (F.col(c) > F.col(f"__stats.{c}_upper")), F.lit(False))
        for c, flag in cols.items()
    }).drop("__stats")


def any_flag(df: DataFrame, keys: Sequence[str], flag: Column, out: str = "has_flag") -> DataFrame:
    """Whether any row of the key is flagged, and its number of rows."""
    return df.groupBy(*keys).agg(F.bool_or(F.coalesce(flag, F.lit(False))).alias(out), F.count(F.lit(1)).alias("n_rows"))


def pick_min(df: DataFrame, keys: Sequence[str], value: str, out: str | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(value).alias(out or value))


def rollup_ids(df: DataFrame, key: str, member: str, names: Sequence[str]) -> DataFrame:
    """One row per key: smallest names, number of distinct members, first and last member.

    The members themselves are rows of ``member_rows``: a list of them would grow
    with the key.
    """
    present = df.where(F.col(key).isNotNull())
    per_member = present.groupBy(key, member).agg(*[F.min(n).alias(n) for n in names])
    return per_member.groupBy(key).agg(
        *[F.min(n).alias(n) for n in names], F.count(member).alias("member_count"), F.min(member).alias("first_member"), F.max(member).alias("last_member")
    )


def member_rows(df: DataFrame, key: str, member: str) -> DataFrame:
    """One row per key and member."""
    return df.where(F.col(key).isNotNull() & F.col(member).isNotNull()).select(key, member).distinct()


def collapse(df: DataFrame, key: str, flags: Sequence[str] = (), skip: Sequence[str] = ()) -> DataFrame:
    """One row per key: smallest non-null value of each column, any-true of the flags."""
    rest = [c for c in df.columns if c != key and c not in flags and c not in skip]
    return df.groupBy(key).agg(
        *[F.min(c).alias(c) for c in rest], *[F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in flags]
    )


def extremes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("min", F.min), ("max", F.max))])


def pass_counts(df: DataFrame, group: str, ok: Column) -> DataFrame:
    """Rows, passing rows and removed rows per group."""
    return (
        df.groupBy(group).agg(F.count(F.lit(1)).alias("n_before"), F.count_if(ok).alias("n_after"))
        .withColumn("n_removed", F.col("n_before") - F.col("n_after"))
    )


def shares(df: DataFrame, col: str, count: str = "n", percent: str = "percentage") -> DataFrame:
    """Count and percent of all rows per category; nulls form a category."""
    counted = df.groupBy(col).agg(F.count(F.lit(1)).alias(count))
    total = counted.agg(F.sum(count).alias("total")).scalar()
    return counted.withColumn(percent, F.coalesce(ratio(F.col(count), total) * 100.0, F.lit(0.0)))


def mapping_summary(all_ids: DataFrame, mapped: DataFrame, key: str) -> DataFrame:
    """Mapped and unmapped counts with percentages; zero percent when there is nothing."""
    total = all_ids.agg(F.count(F.lit(1)).alias("n")).scalar()
    found = mapped.agg(F.count_distinct(key).alias("n")).scalar()
    rows = mapped.sparkSession.createDataFrame([(K.MAPPED_LABEL, 1), (K.UNMAPPED_LABEL, 2)], "mapping_status string, part int")
    n = F.when(F.col("part") == 1, F.col("__found")).otherwise(F.greatest(F.col("__total") - F.col("__found"), F.lit(0)))
    return (
        rows.withColumns({"__total": total, "__found": found})
        .withColumn("gene_count", n.cast("bigint"))
        .withColumn("percentage", F.coalesce(ratio(F.col("gene_count"), F.col("__total")) * 100.0, F.lit(0.0)))
        .select("mapping_status", "gene_count", "percentage")
    )


def distinct_by(df: DataFrame, group: str, member: str, out: str) -> DataFrame:
    return df.groupBy(group).agg(F.count_distinct(member).alias(out))


def exclusion_reason(library: Column, detected: Column) -> Column:
    lib, det = F.coalesce(library, F.lit(False)), F.coalesce(detected, F.lit(False))
    return (
        F.when(lib & det, K.EXCLUDED_BOTH).when(lib, K.EXCLUDED_LIBRARY).when(det, K.EXCLUDED_DETECTED)
        .otherwise(K.EXCLUDED_OTHER)
    )


def exclusions(df: DataFrame, library: str, detected: str) -> DataFrame:
    """Excluded rows per reason."""
    out = F.coalesce(F.col(library), F.lit(False)) | F.coalesce(F.col(detected), F.lit(False))
    return (
        df.where(out).groupBy(exclusion_reason(F.col(library), F.col(detected)).alias("exclusion_reason"))
        .agg(F.count(F.lit(1)).alias("sample_count"))
    )


def histogram(df: DataFrame, col: str, edges: Sequence[float], count: str = "n", group: str | None = None) -> DataFrame:
    """Counts in half-open bins [edge, next edge), in one pass; values outside are left out.

    Ungrouped, every bin is reported; grouped, only the bins that occur.
    """
    bins = list(zip(edges, edges[1:]))
    value = F.col(col)
    inside = [(value >= a) & (value < b) for a, b in bins]
    if group is None:
        counts = df.agg(*[F.count_if(c).alias(f"b{i}") for i, c in enumerate(inside)])
        rows = F.array(*[
            F.struct(
                F.lit(float(a)).alias("bin_start"), F.lit(float(b)).alias("bin_end"), F.col(f"b{i}").alias(count)
            )
            for i, (a, b) in enumerate(bins)
        ])
        return counts.select(F.inline(rows))
    start, end = None, None
    for cond, (a, b) in zip(inside, bins):
        start = F.when(cond, F.lit(float(a))) if start is None else start.when(cond, F.lit(float(a)))
        end = F.when(cond, F.lit(float(b))) if end is None else end.when(cond, F.lit(float(b)))
    return (
        df.select(start.alias("bin_start"), end.alias("bin_end"), group)
        .where(F.col("bin_start").isNotNull())
        .groupBy("bin_start", "bin_end", group).agg(F.count(F.lit(1)).alias(count))
    )


def cluster_profile(
    df: DataFrame, cluster: str, means: Mapping[str, str], expression: str, network: str,
    label: str = "candidate_group", accuracy: int = K.QUANTILE_ACCURACY,
) -> DataFrame:
    """Size and means per cluster, labelled against the medians of all rows."""
    medians = df.agg(
        F.percentile_approx(expression, 0.5, accuracy).cast("double").alias("expression"),
        F.percentile_approx(network, 0.5, accuracy).cast("double").alias("network"),
    )
    sized = df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("num_candidates"), *[F.avg(c).alias(out) for c, out in means.items()]
    )
    strong_x = F.col(means[expression]) >= F.col("__stats.expression")
    strong_n = F.col(means[network]) >= F.col("__stats.network")
    name = (
        F.when(strong_x & strong_n, K.CLUSTER_BOTH).when(strong_x & ~strong_n, K.CLUSTER_EXPRESSION)
        .when(~strong_x & strong_n, K.CLUSTER_NETWORK).otherwise(K.CLUSTER_LOW)
    )
    return with_stats(sized, medians).withColumn(label, name).drop("__stats")


def feature_ranges(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Exact min, median and max of each feature per key, long form, nulls skipped.

    ``df`` is read twice and should be a stored table.
    """
    long = melt(df.select(*keys, *features), keys, features, "feature", "value")
    by = [*keys, "feature"]
    ends = long.groupBy(*by).agg(F.min("value").alias("min"), F.max("value").alias("max"))
    return ends.join(exact_quantiles(long, by, "value", {"median": 0.5}), by)


def explain_clusters(
    points: DataFrame, top: DataFrame, cluster: str, rank: str, name: str, names_shown: int = 10
) -> DataFrame:
    """Share of all points, share and capture of the top list, and leading names per cluster.

    ``top`` is a bounded list (the first ranks), so its per-cluster name lists are short.
    """
    sizes = points.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count(F.lit(1)).alias("members"))
    total = points.agg(F.count(F.lit(1)).alias("n")).scalar()
    total_top = top.agg(F.count(F.lit(1)).alias("n")).scalar()
    in_top = top.where(F.col(cluster).isNotNull())
    counts = in_top.groupBy(cluster).agg(F.count(F.lit(1)).alias("top_count"))
    lead = n_per_group(in_top.select(cluster, rank, name), [cluster], [F.col(rank)], names_shown)
    lists = lead.groupBy(cluster).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(rank, name))), lambda s: s[name]), ", ").alias("top_names")
    )
    joined = sizes.join(counts, cluster, "left").join(lists, cluster, "left")
    hits = F.coalesce(F.col("top_count"), F.lit(0))
    return joined.select(
        cluster,
        "members",
        hits.cast("bigint").alias("top_count"),
        F.coalesce(ratio(F.col("members"), total) * 100.0, F.lit(0.0)).alias("population_percentage"),
        F.coalesce(ratio(hits, total_top) * 100.0, F.lit(0.0)).alias("top_percentage"),
        F.coalesce(ratio(hits, F.col("members")) * 100.0, F.lit(0.0)).alias("capture_rate"),
        F.coalesce("top_names", F.lit("")).alias("top_names"),
    )


def dedup(df: DataFrame, keys: Sequence[str] | None = None, order: Sequence[Column] = ()) -> DataFrame:
    """Distinct rows; with keys, the first row per key in the given order."""
    if keys is None:
        return df.distinct()
    return n_per_group(df, keys, order, 1)


def mean_replicates(df: DataFrame, keys: Sequence[str], value: str, out: str | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(out or value))


def support_stats(
    df: DataFrame, key: str, sample: str, value: str, percentile: str, total: Column, accuracy: int = K.QUANTILE_ACCURACY,
    top: float = K.TOP_QUARTILE,
) -> DataFrame:
    """Coverage, mean, median, mean percentile and top-quartile rate per key.

    Rate and coverage divide by ``total``, the number of all matched samples.
    ``df`` has one row per key and sample.
    """
    return df.groupBy(key).agg(
        F.count(sample).alias("n_available"),
        F.avg(value).alias("mean_value"),
        F.percentile_approx(value, 0.5, accuracy).cast("double").alias("median_value"),
        F.avg(percentile).alias("mean_percentile"),
        F.count_if(F.col(percentile) >= top).alias("__top"),
    ).withColumn("n_total", total.cast("bigint")).select(
        key, "n_available", "n_total",
        ratio(F.col("n_available"), F.col("n_total")).alias("coverage_rate"),
        "mean_value", "median_value", "mean_percentile",
        ratio(F.col("__top"), F.col("n_total")).alias("top_quartile_rate"),
    )


def describe_features(df: DataFrame, cols: Sequence[str], accuracy: int = K.QUANTILE_ACCURACY) -> DataFrame:
    """Count, mean, standard deviation, min, quartiles and max, one row per column, one pass."""
    one = df.agg(*[
        F.struct(
            F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("stddev"),
            F.min(c).cast("double").alias("min"), F.percentile_approx(c, [0.25, 0.5, 0.75], accuracy).alias("q"),
            F.max(c).cast("double").alias("max"),
        ).alias(f"s{i}")
        for i, c in enumerate(cols)
    ])
    rows = F.array(*[
        F.struct(
            *[F.col(f"s{i}.{f}").alias(f) for f in ("column", "count", "mean", "stddev", "min")],
            *[F.col(f"s{i}.q")[j].cast("double").alias(n) for j, n in enumerate(("q25", "q50", "q75"))],
            F.col(f"s{i}.max").alias("max"),
        )
        for i in range(len(cols))
    ])
    return one.select(F.inline(rows))


def overview(df: DataFrame, by: Sequence[str], distinct: Mapping[str, str]) -> DataFrame:
    """Rows and distinct values per group; nulls form a group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_distinct(c).alias(o) for c, o in distinct.items()])


def kpi_table(parts: Sequence[tuple[str, DataFrame, str, str, str]]) -> DataFrame:
    """Named one-number results as rows: (name, one-cell frame, unit, phase, description)."""
    spark = parts[0][1].sparkSession
    names = [(i, n, u, p, d) for i, (n, _, u, p, d) in enumerate(parts)]
    rows = spark.createDataFrame(
        names, "metric_no int, metric_name string, metric_unit string, phase_name string, description string"
    )
    value = None
    for i, (_, cell, _, _, _) in enumerate(parts):
        v = cell.scalar().cast("double")
        value = F.when(F.col("metric_no") == i, v) if value is None else value.when(F.col("metric_no") == i, v)
    return rows.withColumn("metric_value", value)
