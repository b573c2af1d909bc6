"""Checked queries for aggregations."""

from pyspark.sql import functions as F

from provenor.catalogue.base import big, edge_tasks, query, r6, tab, with_views, x_alias, x_cluster, x_diff, x_edges, x_expr, x_map, x_qc, x_targets
from provenor.operators import aggregates as agg
from provenor.operators import graph, stats
from provenor.operators.joins import missing
from provenor.operators.sorting import top_k
from provenor.operators.windows import within_percentile
from provenor.plans.snapshots import dashboard_rollups
from provenor.session import materialise


@query("agg_sample_qc", """
SELECT l_suppkey AS sample_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_count, count(*) FILTER (l_quantity > 0) AS n_detected,
       count(*) FILTER (l_extendedprice > 50000) AS n_above_level, quantile_disc(l_extendedprice, 0.5) AS median_level,
       round(count(*) FILTER (l_discount = 0) / count(*), 6) AS zero_share, count(*) FILTER (l_returnflag = 'R') AS n_class
FROM lineitem GROUP BY l_suppkey""")
def agg_sample_qc(spark, sf):
    rows = tab(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("sample_id"), big("l_quantity").alias("count"), F.col("l_extendedprice").alias("level"), "l_returnflag",
        "l_discount",
    )
    qc = agg.sample_qc(rows, ["sample_id"], "count", "level", "l_returnflag", "R", level_min=50000)
    zero = agg.sample_qc(rows, ["sample_id"], "l_discount", "level", "l_returnflag", "R").select("sample_id", r6("zero_share").alias("zero_share"))
    return qc.drop("zero_share").join(zero, "sample_id")


@query("agg_iqr_flags", with_views("x_qc", body="""
, q AS (SELECT quantile_disc(total_count, 0.25) AS a1, quantile_disc(total_count, 0.75) AS a3, quantile_disc(n_detected, 0.25) AS b1, quantile_disc(n_detected, 0.75) AS b3 FROM x_qc)
SELECT sample_id, a3 > a1 AND (total_count < a1 - 1.5 * (a3 - a1) OR total_count > a3 + 1.5 * (a3 - a1)) AS is_outlier_library_size,
       b3 > b1 AND (n_detected < b1 - 1.5 * (b3 - b1) OR n_detected > b3 + 1.5 * (b3 - b1)) AS is_outlier_detected_genes FROM x_qc, q"""))
def agg_iqr_flags(spark, sf):
    flagged = agg.iqr_flags(x_qc(spark, sf), {"total_count": "is_outlier_library_size", "n_detected": "is_outlier_detected_genes"})
    return flagged.select("sample_id", "is_outlier_library_size", "is_outlier_detected_genes")


@query("agg_any_flag", """
SELECT l_suppkey, l_returnflag, bool_or(l_discount > 0.09 AND l_tax > 0.07) AS has_flag, count(*) AS n_rows FROM lineitem GROUP BY 1, 2""")
def agg_any_flag(spark, sf):
    return agg.any_flag(tab(spark, sf, "lineitem"), ["l_suppkey", "l_returnflag"], (F.col("l_discount") > 0.09) & (F.col("l_tax") > 0.07))


@query("agg_group_moments", with_views("x_moments", body="""
SELECT gene, grp, round(ln(mean_value), 6) AS ln_mean_value, round(mean_log, 6) AS mean_log, round(var_log, 6) AS var_log, n_values, n_samples FROM x_moments"""))
def agg_group_moments(spark, sf):
    m = stats.group_moments(x_expr(spark, sf), ["gene"], "grp", "value", "log_value", "sample_id")
    return m.select("gene", "grp", r6(F.log("mean_value")).alias("ln_mean_value"), r6("mean_log").alias("mean_log"), r6("var_log").alias("var_log"), "n_values", "n_samples")


@query("agg_two_group_test", with_views("x_diff", body="""
SELECT gene, round(ln(mean_case), 6) AS ln_mean_case, round(ln(mean_control), 6) AS ln_mean_control, round(effect, 6) AS effect, round(t_stat, 6) AS t_stat, round(p_value, 6) AS p_value FROM x_diff"""))
def agg_two_group_test(spark, sf):
    d = stats.two_group_test(x_expr(spark, sf), ["gene"], "grp", "value", "log_value", "case", "control")
    return d.select(
        "gene", r6(F.log("mean_value_case")).alias("ln_mean_case"), r6(F.log("mean_value_control")).alias("ln_mean_control"), r6("effect").alias("effect"),
        r6("t_stat").alias("t_stat"), r6("p_value").alias("p_value"),
    )


@query("agg_diff_call", with_views("x_diff", body="SELECT gene, direction, is_deg AS is_different FROM x_diff"))
def agg_diff_call(spark, sf):
    return x_diff(spark, sf).select("gene", "direction", "is_different")


@query("agg_degree", with_views("x_edges", body="""
SELECT node, count(DISTINCT other) AS degree, round(sum(weight), 4) AS weighted_degree
FROM (SELECT src AS node, dst AS other, weight FROM x_edges UNION ALL SELECT dst, src, weight FROM x_edges) GROUP BY node"""))
def agg_degree(spark, sf):
    d = graph.degrees(x_edges(spark, sf), "src", "dst", "weight", parts=edge_tasks(spark, sf, 2))
    return d.select("node", "degree", r6("weighted_degree", 4).alias("weighted_degree"))


@query("agg_neighbour_features", with_views("x_edges", body="""
, l AS (SELECT DISTINCT * FROM (SELECT src AS node, dst AS other, score, weight FROM x_edges UNION ALL SELECT dst, src, score, weight FROM x_edges) WHERE weight >= 0.4)
SELECT node, count(DISTINCT other) AS n_interactions, round(avg(score), 4) AS avg_score, max(score) AS max_score, count(DISTINCT other) FILTER (weight >= 0.7) AS n_high
FROM l WHERE node IN (SELECT 'P' || p_partkey FROM part WHERE p_size < 20 UNION ALL SELECT 'S' || s_suppkey FROM supplier) GROUP BY node"""))
def agg_neighbour_features(spark, sf):
    nodes = tab(spark, sf, "part").where("p_size < 20").select(F.concat(F.lit("P"), "p_partkey").alias("node"))
    nodes = nodes.unionByName(tab(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("node")))
    f = graph.interaction_features(x_edges(spark, sf), nodes, "node", "src", "dst", "score", "weight", parts=edge_tasks(spark, sf, 2))
    return f.withColumn("avg_score", r6("avg_score", 4))


@query("agg_pick_min", with_views("x_alias", body="SELECT protein_id, source, min(alias_value) AS alias_value FROM x_alias GROUP BY 1, 2"))
def agg_pick_min(spark, sf):
    return agg.pick_min(x_alias(spark, sf), ["protein_id", "source"], "alias_value")


@query("agg_entity_map", with_views("x_map", body="SELECT * FROM x_map"))
def agg_entity_map(spark, sf):
    return x_map(spark, sf)


@query("agg_rollup_ids", with_views("x_map", body="""
SELECT brand, min(symbol) AS symbol, count(DISTINCT protein_id) AS member_count, min(protein_id) AS first_member, max(protein_id) AS last_member
FROM x_map WHERE brand IS NOT NULL GROUP BY 1"""))
def agg_rollup_ids(spark, sf):
    return agg.rollup_ids(x_map(spark, sf), "brand", "protein_id", ["symbol"])


@query("agg_member_rows", with_views("x_map", body="""
SELECT DISTINCT brand, protein_id FROM x_map WHERE brand IS NOT NULL AND protein_id IS NOT NULL"""))
def agg_member_rows(spark, sf):
    return agg.member_rows(x_map(spark, sf), "brand", "protein_id")


@query("agg_collapse", """
SELECT o_custkey, min(o_orderstatus) AS o_orderstatus, min(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END) AS priority, bool_or(o_totalprice > 400000) AS is_big FROM orders GROUP BY 1""")
def agg_collapse(spark, sf):
    rows = tab(spark, sf, "orders").select(
        "o_custkey", "o_orderstatus", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("priority"), (F.col("o_totalprice") > 400000).alias("is_big")
    )
    return agg.collapse(rows, "o_custkey", flags=["is_big"])


@query("agg_extremes", """
SELECT min(l_extendedprice) AS min_l_extendedprice, max(l_extendedprice) AS max_l_extendedprice, min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity FROM lineitem""")
def agg_extremes(spark, sf):
    return agg.extremes(tab(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"])


@query("agg_pass_counts", with_views("x_qc", body="""
SELECT grp, count(*) AS n_before, count(*) FILTER (n_detected > 200) AS n_after, count(*) - count(*) FILTER (n_detected > 200) AS n_removed FROM x_qc GROUP BY grp"""))
def agg_pass_counts(spark, sf):
    return agg.pass_counts(x_qc(spark, sf), "grp", F.col("n_detected") > 200)


@query("agg_shares", "SELECT o_orderpriority, count(*) AS n, round(100.0e0 * count(*) / (SELECT count(*) FROM orders), 6) AS percentage FROM orders GROUP BY 1")
def agg_shares(spark, sf):
    return agg.shares(tab(spark, sf, "orders"), "o_orderpriority").withColumn("percentage", r6("percentage"))


@query("agg_mapping_summary", """
WITH a AS (SELECT count(*) AS n FROM customer), m AS (SELECT count(DISTINCT c_custkey) AS n FROM customer JOIN orders ON c_custkey = o_custkey * 3)
SELECT 'Mapped to STRING protein' AS mapping_status, m.n AS gene_count, round(100.0e0 * m.n / a.n, 6) AS percentage FROM a, m
UNION ALL SELECT 'Not mapped', a.n - m.n, round(100.0e0 * (a.n - m.n) / a.n, 6) FROM a, m""")
def agg_mapping_summary(spark, sf):
    mapped = tab(spark, sf, "orders").select((F.col("o_custkey") * 3).alias("o_custkey")).join(tab(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    return agg.mapping_summary(tab(spark, sf, "customer"), mapped, "o_custkey").withColumn("percentage", r6("percentage"))


@query("agg_confidence_counts", with_views("x_map", body="SELECT confidence, count(DISTINCT protein_id) AS number_of_proteins FROM x_map GROUP BY 1"))
def agg_confidence_counts(spark, sf):
    return agg.distinct_by(x_map(spark, sf), "confidence", "protein_id", "number_of_proteins")


@query("agg_exclusions", """
WITH f AS (SELECT l_suppkey, sum(l_quantity) % 3 = 0 AS a, count(*) % 2 = 0 AS b FROM lineitem GROUP BY 1)
SELECT CASE WHEN a AND b THEN 'Both library size and detected genes outlier' WHEN a THEN 'Library size outlier' WHEN b THEN 'Detected genes outlier' ELSE 'Other QC exclusion' END AS exclusion_reason,
       count(*) AS sample_count FROM f WHERE a OR b GROUP BY 1""")
def agg_exclusions(spark, sf):
    f = tab(spark, sf, "lineitem").groupBy("l_suppkey").agg((F.sum("l_quantity") % 3 == 0).alias("a"), (F.count(F.lit(1)) % 2 == 0).alias("b"))
    return agg.exclusions(f, "a", "b")


_EDGES = [0, 20000, 40000, 60000, 80000, 90000]


@query("agg_histogram", """
WITH b AS (SELECT * FROM (VALUES (0, 20000), (20000, 40000), (40000, 60000), (60000, 80000), (80000, 90000), (90000, 1000000), (1000000, 2000000)) t(a, b))
SELECT CAST(a AS DOUBLE) AS bin_start, CAST(b AS DOUBLE) AS bin_end, (SELECT count(*) FROM lineitem WHERE l_extendedprice >= a AND l_extendedprice < b) AS n FROM b""")
def agg_histogram(spark, sf):
    return agg.histogram(tab(spark, sf, "lineitem"), "l_extendedprice", [*_EDGES, 1000000, 2000000])


@query("agg_histogram_grouped", """
SELECT CAST(a AS DOUBLE) AS bin_start, CAST(b AS DOUBLE) AS bin_end, l_returnflag, count(*) AS n
FROM (VALUES (0, 20000), (20000, 40000), (40000, 60000), (60000, 80000), (80000, 90000)) t(a, b) JOIN lineitem ON l_extendedprice >= a AND l_extendedprice < b GROUP BY 1, 2, 3""")
def agg_histogram_grouped(spark, sf):
    return agg.histogram(tab(spark, sf, "lineitem"), "l_extendedprice", _EDGES, group="l_returnflag")


_PROFILE_SQL = """
, m AS (SELECT quantile_disc(f1, 0.5) AS a, quantile_disc(f2, 0.5) AS b FROM x_cluster),
p AS (SELECT cluster_id, count(*) AS num_candidates, avg(f1) AS m1, avg(f2) AS m2, avg(score) AS ms FROM x_cluster GROUP BY 1)
SELECT cluster_id, num_candidates, round(m1, 6) AS avg_f1, round(m2, 6) AS avg_f2, round(ms, 6) AS avg_score,
       CASE WHEN m1 >= a AND m2 >= b THEN 'High expression + high network' WHEN m1 >= a THEN 'Expression-driven' WHEN m2 >= b THEN 'Network-driven' ELSE 'Lower priority' END AS candidate_group FROM p, m"""


@query("agg_cluster_profile", with_views("x_cluster", body=_PROFILE_SQL))
def agg_cluster_profile(spark, sf):
    p = agg.cluster_profile(x_cluster(spark, sf), "cluster_id", {"f1": "avg_f1", "f2": "avg_f2", "score": "avg_score"}, "f1", "f2")
    return p.withColumns({c: r6(c) for c in ("avg_f1", "avg_f2", "avg_score")})


@query("agg_cluster_explain", with_views("x_cluster", body="""
, t AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM x_cluster QUALIFY rank <= 100),
s AS (SELECT cluster_id, count(*) AS members FROM x_cluster GROUP BY 1),
h AS (SELECT cluster_id, count(*) AS top_count, string_agg('v' || vec_id, ', ' ORDER BY rank) FILTER (k <= 10) AS top_names FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY rank) AS k FROM t) GROUP BY 1)
SELECT s.cluster_id, members, coalesce(top_count, 0) AS top_count, round(100.0e0 * members / (SELECT count(*) FROM x_cluster), 6) AS population_percentage,
       round(100.0e0 * coalesce(top_count, 0) / (SELECT count(*) FROM t), 6) AS top_percentage, round(100.0e0 * coalesce(top_count, 0) / members, 6) AS capture_rate, coalesce(top_names, '') AS top_names
FROM s LEFT JOIN h ON s.cluster_id = h.cluster_id"""))
def agg_cluster_explain(spark, sf):
    points = x_cluster(spark, sf).withColumn("name", F.concat(F.lit("v"), "vec_id"))
    top = top_k(points, [F.col("score").desc(), F.col("vec_id")], 100)
    e = agg.explain_clusters(points, top, "cluster_id", "rank", "name")
    return e.withColumns({c: r6(c) for c in ("population_percentage", "top_percentage", "capture_rate")})


@query("agg_feature_ranges", with_views("x_cluster", body="""
SELECT cluster_id, feature, round(min(v), 6) AS min, round(quantile_cont(v, 0.5), 6) AS median, round(max(v), 6) AS max
FROM (SELECT cluster_id, 'f1' AS feature, f1 AS v FROM x_cluster UNION ALL SELECT cluster_id, 'f2', f2 FROM x_cluster UNION ALL SELECT cluster_id, 'f3', CASE WHEN f3 > -0.1 THEN f3 END FROM x_cluster) GROUP BY 1, 2"""))
def agg_feature_ranges(spark, sf):
    rows = x_cluster(spark, sf).withColumn("f3", F.when(F.col("f3") > -0.1, F.col("f3")))
    return agg.feature_ranges(rows, ["cluster_id"], ["f1", "f2", "f3"]).withColumns({c: r6(c) for c in ("min", "median", "max")})


@query("agg_distinct", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def agg_distinct(spark, sf):
    return agg.dedup(tab(spark, sf, "lineitem").select("l_partkey", "l_suppkey"))


@query("agg_dedup_keyed", """
SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""")
def agg_dedup_keyed(spark, sf):
    rows = tab(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return agg.dedup(rows, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")])


@query("agg_replicate_mean", with_views("x_expr", body="SELECT gene, sample_id, round(avg(log_value), 6) AS log_value FROM x_expr GROUP BY 1, 2"))
def agg_replicate_mean(spark, sf):
    return agg.mean_replicates(x_expr(spark, sf), ["gene", "sample_id"], "log_value").withColumn("log_value", r6("log_value"))


@query("agg_support_stats", with_views("x_expr", body="""
, v AS (SELECT gene, sample_id, avg(value) AS value FROM x_expr GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY sample_id) <= 1 THEN 1.0e0 ELSE percent_rank() OVER (PARTITION BY sample_id ORDER BY value, gene) END AS pct FROM v),
t AS (SELECT count(DISTINCT sample_id) AS n FROM v)
SELECT gene, count(DISTINCT sample_id) AS n_available, any_value(t.n) AS n_total, round(count(DISTINCT sample_id) / any_value(t.n), 6) AS coverage_rate, round(ln(avg(value)), 6) AS mean_value,
       round(ln(quantile_disc(value, 0.5)), 6) AS median_value, round(avg(pct), 6) AS mean_percentile, round(count(*) FILTER (pct >= 0.75) / any_value(t.n), 6) AS top_quartile_rate
FROM p, t GROUP BY gene"""))
def agg_support_stats(spark, sf):
    values = materialise(agg.mean_replicates(x_expr(spark, sf), ["gene", "sample_id"], "value"), "values")
    total = values.agg(F.count_distinct("sample_id").alias("n")).scalar()
    s = agg.support_stats(within_percentile(values, ["sample_id"], "value", "gene", stored=True), "gene", "sample_id", "value", "percentile", total)
    logs = s.withColumns({"mean_value": F.log("mean_value"), "median_value": F.log("median_value")})
    return logs.withColumns({c: r6(c) for c in ("coverage_rate", "mean_value", "median_value", "mean_percentile", "top_quartile_rate")})


@query("agg_summary", with_views("x_cluster", body="""
SELECT 'f1' AS column, count(f1) AS count, round(avg(f1), 6) AS mean, round(stddev_samp(f1), 6) AS stddev, round(min(f1), 6) AS min, round(quantile_disc(f1, 0.25), 6) AS q25, round(quantile_disc(f1, 0.5), 6) AS q50, round(quantile_disc(f1, 0.75), 6) AS q75, round(max(f1), 6) AS max FROM x_cluster
UNION ALL SELECT 'f2', count(f2), round(avg(f2), 6), round(stddev_samp(f2), 6), round(min(f2), 6), round(quantile_disc(f2, 0.25), 6), round(quantile_disc(f2, 0.5), 6), round(quantile_disc(f2, 0.75), 6), round(max(f2), 6) FROM x_cluster"""))
def agg_summary(spark, sf):
    d = agg.describe_features(x_cluster(spark, sf), ["f1", "f2"])
    return d.withColumns({c: r6(c) for c in ("mean", "stddev", "min", "q25", "q50", "q75", "max")})


@query("agg_overview", with_views("x_expr", body="SELECT grp, count(*) AS n_rows, count(DISTINCT sample_id) AS n_samples, count(DISTINCT gene) AS n_genes FROM x_expr GROUP BY grp"))
def agg_overview(spark, sf):
    return agg.overview(x_expr(spark, sf), ["grp"], {"sample_id": "n_samples", "gene": "n_genes"})


@query("agg_kpis", with_views("x_diff", body="""
SELECT 'samples' AS metric_name, CAST(count(DISTINCT sample_id) AS DOUBLE) AS metric_value, 'samples' AS metric_unit FROM x_expr
UNION ALL SELECT 'different genes', CAST(count(*) FILTER (is_deg) AS DOUBLE), 'genes' FROM x_diff
UNION ALL SELECT 'orders', CAST(count(*) AS DOUBLE), 'orders' FROM orders"""))
def agg_kpis(spark, sf):
    t = agg.kpi_table([
        ("samples", x_expr(spark, sf).agg(F.count_distinct("sample_id").alias("n")), "samples", "QC", "samples with values"),
        ("different genes", x_diff(spark, sf).agg(F.count_if("is_different").alias("n")), "genes", "difference", "called genes"),
        ("orders", tab(spark, sf, "orders").agg(F.count(F.lit(1)).alias("n")), "orders", "overview", "all orders"),
    ])
    return t.select("metric_name", "metric_value", "metric_unit")


@query("agg_rollups", with_views("x_edges", "x_targets", "x_qc", body="""
, d AS (SELECT node, sum(weight) AS w FROM (SELECT src AS node, weight FROM x_edges UNION ALL SELECT dst, weight FROM x_edges) GROUP BY node)
SELECT 'average weighted degree' AS metric_name, round(avg(w), 4) AS metric_value FROM d
UNION ALL SELECT 'largest weight', max(weight) FROM x_edges
UNION ALL SELECT 'moderate support', CAST(count(*) AS DOUBLE) FROM x_targets WHERE geo_support_level = 'Moderate GEO support'
UNION ALL SELECT 'removed samples', CAST(count(*) AS DOUBLE) FROM x_qc WHERE n_detected <= 200"""))
def agg_rollups(spark, sf):
    edges = x_edges(spark, sf)
    return dashboard_rollups({
        "average weighted degree": (graph.degrees(edges, "src", "dst", "weight", parts=edge_tasks(spark, sf, 2)), r6(F.avg("weighted_degree"), 4)),
        "largest weight": (edges, F.max("weight")),
        "moderate support": (x_targets(spark, sf), F.count_if(F.col("geo_support_level") == "Moderate GEO support")),
        "removed samples": (x_qc(spark, sf), F.count_if(F.col("n_detected") <= 200)),
    })


@query("agg_unmapped", with_views("x_map", "x_diff", body="""
SELECT gene, round(effect, 6) AS effect FROM x_diff WHERE gene NOT IN (SELECT symbol FROM x_map WHERE symbol IS NOT NULL)"""))
def agg_unmapped(spark, sf):
    names = x_map(spark, sf).where("symbol IS NOT NULL").select(F.col("symbol").alias("gene"))
    return missing(x_diff(spark, sf), names, ["gene"]).select("gene", r6("effect").alias("effect"))
