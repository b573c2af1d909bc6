"""Checked queries for whole steps of the ranking on the derived tables."""

from pyspark.sql import functions as F

from provenor.catalogue.base import big, edge_tasks, query, r6, tab, with_views
from provenor.catalogue.scoring import RANKING_VIEWS, expression, gene_map, protein_edges, ranking_inputs
from provenor.plans import clusters, evidence, mapping, refine, snapshots
from provenor.session import materialise

_COUNTS_SQL = """
counts AS (SELECT 'F' || l_suppkey AS file_id, 'C' || l_suppkey AS case_id, 'S' || l_suppkey AS sample_id, 'Primary Tumor' AS sample_type,
                  CASE WHEN l_suppkey % 3 = 0 THEN 'normal' ELSE 'tumor' END AS sample_group, l_partkey AS gene_id,
                  CASE WHEN p_type = 'ECONOMY' THEN 'protein_coding' ELSE p_type END AS gene_type,
                  CASE WHEN l_discount = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS raw_count, l_extendedprice / 50000 AS tpm
           FROM lineitem JOIN part ON p_partkey = l_partkey),
m AS (SELECT file_id, case_id, sample_id, sample_type, sample_group, CAST(sum(raw_count) AS BIGINT) AS total_raw_count, count(*) FILTER (raw_count > 0) AS detected,
             count(*) FILTER (tpm > 1) AS above, quantile_disc(tpm, 0.5) AS median_tpm, count(*) FILTER (raw_count = 0) / count(*) AS zero_share,
             count(*) FILTER (gene_type = 'protein_coding') AS coding FROM counts GROUP BY 1, 2, 3, 4, 5),
q AS (SELECT quantile_disc(total_raw_count, 0.25) AS a1, quantile_disc(total_raw_count, 0.75) AS a3, quantile_disc(detected, 0.25) AS b1, quantile_disc(detected, 0.75) AS b3 FROM m),
qc AS (SELECT m.*, a3 > a1 AND (total_raw_count < a1 - 1.5 * (a3 - a1) OR total_raw_count > a3 + 1.5 * (a3 - a1)) AS out_lib,
              b3 > b1 AND (detected < b1 - 1.5 * (b3 - b1) OR detected > b3 + 1.5 * (b3 - b1)) AS out_det FROM m, q)
"""


def counts(spark, sf):
    """Derived facts in the shape of the clean count table."""
    part = tab(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    line = tab(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_discount", "l_quantity", "l_extendedprice").join(part, "l_partkey")
    return line.select(
        F.concat(F.lit("F"), "l_suppkey").alias("file_id"), F.concat(F.lit("C"), "l_suppkey").alias("case_id"),
        F.concat(F.lit("S"), "l_suppkey").alias("sample_id"), F.lit("Primary Tumor").alias("sample_type"),
        F.when(F.col("l_suppkey") % 3 == 0, "normal").otherwise("tumor").alias("sample_group"),
        F.col("l_partkey").alias("gene_id_base"), F.col("l_partkey").alias("gene_name"),
        F.when(F.col("p_type") == "ECONOMY", "protein_coding").otherwise(F.col("p_type")).alias("gene_type"),
        F.when(F.col("l_discount") == 0, 0).otherwise(big("l_quantity")).alias("raw_count"), (F.col("l_extendedprice") / 50000).alias("tpm"),
    )


@query("step_quality_check", "WITH " + _COUNTS_SQL + """
SELECT sample_id, sample_group, total_raw_count, detected, above, round(median_tpm, 6) AS median_tpm, round(zero_share, 6) AS zero_share, coding, out_lib, out_det FROM qc""")
def step_quality_check(spark, sf):
    qc = refine.quality_check(counts(spark, sf))
    return qc.select(
        "sample_id", "sample_group", "total_raw_count", F.col("num_detected_genes_raw_gt_0").alias("detected"), F.col("num_detected_genes_tpm_gt_1").alias("above"),
        r6("median_tpm").alias("median_tpm"), r6("pct_zero_genes").alias("zero_share"), F.col("num_protein_coding_genes").alias("coding"),
        F.col("is_outlier_library_size").alias("out_lib"), F.col("is_outlier_detected_genes").alias("out_det"),
    )


@query("step_pass_expression", "WITH " + _COUNTS_SQL + """
SELECT sample_group, gene_id AS gene, count(*) AS n, round(avg(log2(tpm + 1)), 6) AS mean_log FROM counts WHERE sample_id IN (SELECT sample_id FROM qc WHERE NOT (out_lib OR out_det)) GROUP BY 1, 2""")
def step_pass_expression(spark, sf):
    rows = counts(spark, sf)
    passed = evidence.qc_pass_expression(rows, refine.quality_check(rows))
    return passed.groupBy("sample_group", F.col("gene_id_base").alias("gene")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("log2_tpm")).alias("mean_log"))


@query("step_difference", with_views("x_diff", body="""
SELECT gene AS gene_name, round(ln(mean_case), 6) AS ln_mean_tumor, round(ln(mean_control), 6) AS ln_mean_normal, round(effect, 6) AS log2fc, round(p_value, 6) AS p_value, direction, is_deg FROM x_diff"""))
def step_difference(spark, sf):
    d = evidence.difference(expression(spark, sf), "case", "control")
    return d.select(
        "gene_name", r6(F.log("mean_tumor")).alias("ln_mean_tumor"), r6(F.log("mean_normal")).alias("ln_mean_normal"), r6("log2FC").alias("log2fc"),
        r6("p_value").alias("p_value"), F.col("deg_direction").alias("direction"), "is_deg",
    )


@query("step_volcano", with_views("x_diff", body="""
SELECT gene AS gene_name, round(CASE WHEN p_value <= 0 THEN 300 ELSE -log10(CASE WHEN p_value > 0 THEN p_value END) END, 4) AS height,
       round(least(60, CASE WHEN p_value <= 0 THEN 300 ELSE -log10(CASE WHEN p_value > 0 THEN p_value END) END), 4) AS plot_height FROM x_diff WHERE p_value IS NOT NULL"""))
def step_volcano(spark, sf):
    v = snapshots.volcano_points(evidence.difference(expression(spark, sf), "case", "control")).where("p_value IS NOT NULL")
    return v.select("gene_name", r6("minus_log10_p_value", 4).alias("height"), r6("plot_minus_log10_p_value", 4).alias("plot_height"))


@query("step_mapped_evidence", with_views("x_edges", "x_map", "x_diff", body=RANKING_VIEWS + "SELECT gene AS gene_name, protein_id, round(fc, 6) AS log2fc, direction FROM mp"))
def step_mapped_evidence(spark, sf):
    mapped, _ = ranking_inputs(spark, sf)
    return mapped.select("gene_name", "protein_id", r6("log2FC").alias("log2fc"), F.col("deg_direction").alias("direction"))


@query("step_network_features", with_views("x_edges", "x_map", "x_diff", body=RANKING_VIEWS + """
SELECT p.protein_id, coalesce(degree, 0) AS degree, round(coalesce(wd, 0), 4) AS weighted_degree, coalesce(n_int, 0) AS n_int, round(coalesce(avg_score, 0), 4) AS avg_score
FROM (SELECT DISTINCT protein_id FROM mp) p LEFT JOIN deg ON deg.node = p.protein_id LEFT JOIN near ON near.node = p.protein_id"""))
def step_network_features(spark, sf):
    _, feats = ranking_inputs(spark, sf)
    return feats.select(
        "protein_id", F.col("degree_protein").alias("degree"), r6("weighted_degree_protein", 4).alias("weighted_degree"),
        F.col("num_interactions_in_deg_network").alias("n_int"), r6("avg_combined_score", 4).alias("avg_score"),
    )


@query("step_protein_nodes", with_views("x_edges", "x_map", body="""
, b AS (SELECT src AS node, dst AS other, weight FROM x_edges UNION ALL SELECT dst, src, weight FROM x_edges),
d AS (SELECT node, count(DISTINCT other) AS degree, sum(weight) AS wd FROM b GROUP BY node), n AS (SELECT protein_id FROM x_map UNION SELECT node FROM b)
SELECT n.protein_id, brand AS gene_id, symbol AS gene_name, coalesce(degree, 0) AS degree_protein, round(coalesce(wd, 0), 4) AS weighted_degree_protein
FROM n LEFT JOIN x_map m ON m.protein_id = n.protein_id LEFT JOIN d ON d.node = n.protein_id"""))
def step_protein_nodes(spark, sf):
    nodes = mapping.protein_nodes(gene_map(spark, sf), protein_edges(spark, sf), edge_tasks(spark, sf, 2))
    return nodes.select("protein_id", "gene_id", "gene_name", "degree_protein", r6("weighted_degree_protein", 4).alias("weighted_degree_protein"))


def _all_genes(spark, sf):
    """Parts by brand and suppliers by nation, so that both ends of an edge have a gene."""
    s = tab(spark, sf, "supplier").select(
        F.concat(F.lit("S"), "s_suppkey").alias("protein_id"), F.lit(None).cast("string").alias("ensp_id"), F.concat(F.lit("N"), "s_nationkey").alias("gene_id"),
        F.col("s_name").alias("gene_name"), F.upper("s_name").alias("gene_name_norm"), F.lit("high").alias("gene_confidence"),
    )
    return gene_map(spark, sf).unionByName(s)


_GENE_EDGES_SQL = """
, g AS (SELECT protein_id, brand AS gene_id, symbol AS gene_name FROM x_map UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, s_name FROM supplier),
ge AS (SELECT a.gene_id AS gene_id_src, b.gene_id AS gene_id_dst, max(score) AS max_score, max(weight) AS max_weight, count(*) AS protein_edge_count
       FROM x_edges JOIN g a ON a.protein_id = src JOIN g b ON b.protein_id = dst WHERE a.gene_id IS NOT NULL AND b.gene_id IS NOT NULL AND a.gene_id <> b.gene_id GROUP BY 1, 2)
"""


@query("step_gene_edges", with_views("x_edges", "x_map", body=_GENE_EDGES_SQL + "SELECT gene_id_src, gene_id_dst, max_score, max_weight, protein_edge_count FROM ge"))
def step_gene_edges(spark, sf):
    e = mapping.gene_edges(protein_edges(spark, sf), _all_genes(spark, sf), edge_tasks(spark, sf))
    return e.select(
        "gene_id_src", "gene_id_dst", F.col("max_combined_score_gene").alias("max_score"), F.col("max_edge_weight_gene").alias("max_weight"), "protein_edge_count"
    )


@query("step_gene_nodes", with_views("x_edges", "x_map", body=_GENE_EDGES_SQL + """
, b AS (SELECT gene_id_src AS n, gene_id_dst AS o, max_weight AS w FROM ge UNION ALL SELECT gene_id_dst, gene_id_src, max_weight FROM ge),
d AS (SELECT n, count(DISTINCT o) AS degree, sum(w) AS wd FROM b GROUP BY n)
SELECT gene_id, min(gene_name) AS gene_name, any_value(coalesce(degree, 0)) AS degree_gene, round(any_value(coalesce(wd, 0)), 4) AS weighted_degree_gene, count(DISTINCT protein_id) AS protein_count FROM g LEFT JOIN d ON d.n = gene_id WHERE gene_id IS NOT NULL GROUP BY gene_id"""))
def step_gene_nodes(spark, sf):
    genes = _all_genes(spark, sf)
    n = mapping.gene_nodes(genes, materialise(mapping.gene_edges(protein_edges(spark, sf), genes, edge_tasks(spark, sf)), "gene_edges"))
    return n.select(
        "gene_id", "gene_name", "degree_gene", r6("weighted_degree_gene", 4).alias("weighted_degree_gene"), "protein_count",
    )


@query("step_ml_features", with_views("x_edges", "x_map", "x_diff", body=RANKING_VIEWS + """
SELECT protein_id, round(afc, 6) AS abs_log2fc, round(ln(1 + wd), 6) AS log_weighted_degree, round(avg_score, 4) AS avg_score, round(ln(1 + n_int), 6) AS log_num_interactions, round(final_score, 6) AS final_score FROM rk"""))
def step_ml_features(spark, sf):
    f = clusters.ml_features(evidence.candidate_features(*ranking_inputs(spark, sf)))
    return f.select(
        "protein_id", r6("abs_log2FC").alias("abs_log2fc"), r6("log_weighted_degree").alias("log_weighted_degree"), r6("avg_combined_score", 4).alias("avg_score"),
        r6("log_num_interactions").alias("log_num_interactions"), r6("final_score").alias("final_score"),
    )
