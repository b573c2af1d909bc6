"""Checked queries for window-shaped operators."""

from pyspark.sql import functions as F

from provenor.catalogue.base import big, edge_tasks, query, r6, tab, with_views, x_edges, x_expr, x_map, x_targets
from provenor.operators import windows
from provenor.operators.aggregates import mean_replicates
from provenor.operators.joins import attach_ends
from provenor.operators.sorting import global_rank


@query("win_best_evidence", """
SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, l_tax FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, nullif(l_tax, 0) ASC NULLS LAST, l_extendedprice, l_orderkey, l_linenumber) = 1""")
def win_best_evidence(spark, sf):
    rows = tab(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_tax", "l_quantity")
    best = windows.best_by(rows, ["l_suppkey"], [
        F.col("l_quantity").desc(), F.nullif("l_tax", F.lit(0.0)).asc_nulls_last(), F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"),
    ])
    return best.drop("l_quantity")


@query("win_canonical_edges", with_views("x_edges", "x_map", body="""
, e AS (SELECT src, dst, score, weight FROM x_edges UNION ALL SELECT dst, src, score + 1, weight FROM x_edges WHERE score > 500 UNION ALL SELECT src, src, score, weight FROM x_edges UNION ALL SELECT src, NULL, score, weight FROM x_edges),
j AS (SELECT CASE WHEN left(e.src, 1) = 'P' THEN m1.brand ELSE 'N' || n1.s_nationkey END AS a, CASE WHEN left(e.dst, 1) = 'P' THEN m2.brand ELSE 'N' || n2.s_nationkey END AS b, e.src AS ea, e.dst AS eb, score, weight
      FROM e LEFT JOIN x_map m1 ON m1.protein_id = e.src LEFT JOIN x_map m2 ON m2.protein_id = e.dst LEFT JOIN supplier n1 ON 'S' || n1.s_suppkey = e.src LEFT JOIN supplier n2 ON 'S' || n2.s_suppkey = e.dst),
o AS (SELECT least(a, b) AS a, greatest(a, b) AS b, CASE WHEN a <= b THEN ea ELSE eb END AS ea, CASE WHEN a <= b THEN eb ELSE ea END AS eb, score, weight FROM j WHERE a <> b)
SELECT a AS gene_src, b AS gene_dst, ea AS ensp_src, eb AS ensp_dst, max(score) OVER w AS max_score, max(weight) OVER w AS max_weight, count(*) OVER w AS edge_count
FROM o WINDOW w AS (PARTITION BY a, b) QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY score DESC, ea, eb) = 1"""))
def win_canonical_edges(spark, sf):
    e = x_edges(spark, sf)
    back = e.where("score > 500").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("score") + 1).alias("score"), "weight")
    both = (
        e.unionByName(back).unionByName(e.withColumn("dst", F.col("src")))
        .unionByName(e.withColumn("dst", F.lit(None).cast("string")))
    )
    names = x_map(spark, sf).select(F.col("protein_id").alias("id"), F.col("brand").alias("gene"))
    names = names.unionByName(tab(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("id"), F.concat(F.lit("N"), "s_nationkey").alias("gene")))
    named = attach_ends(both, names, "id", "src", "dst", how="inner", parts=edge_tasks(spark, sf, 4)).withColumnsRenamed({"src": "ensp_src", "dst": "ensp_dst"})
    return windows.canonical_edges(named, "gene_src", "gene_dst", [("ensp_src", "ensp_dst")], "score", "weight", ("ensp_src", "ensp_dst"))


@query("win_percent_rank", with_views("x_expr", body="""
, v AS (SELECT sample_id, gene, avg(value) AS value FROM x_expr GROUP BY 1, 2)
SELECT sample_id, gene, round(CASE WHEN count(*) OVER (PARTITION BY sample_id) <= 1 THEN 1 ELSE percent_rank() OVER (PARTITION BY sample_id ORDER BY value, gene) END, 6) AS percentile,
       CASE WHEN count(*) OVER (PARTITION BY sample_id) <= 1 THEN true ELSE percent_rank() OVER (PARTITION BY sample_id ORDER BY value, gene) >= 0.75 END AS is_top_quartile FROM v"""))
def win_percent_rank(spark, sf):
    values = mean_replicates(x_expr(spark, sf), ["sample_id", "gene"], "value")
    placed = windows.within_percentile(values, ["sample_id"], "value", "gene")
    return placed.select("sample_id", "gene", r6("percentile").alias("percentile"), "is_top_quartile")


@query("win_global_rank", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders""")
def win_global_rank(spark, sf):
    rows = tab(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return global_rank(rows, [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()]).drop("o_totalprice")


@query("win_support_rank", with_views("x_targets", body="""
SELECT rank, round(final_score, 6) AS final_score, row_number() OVER (ORDER BY final_score DESC NULLS LAST, rank) AS support_rank FROM x_targets"""))
def win_support_rank(spark, sf):
    ranked = windows.support_rank(x_targets(spark, sf).select("rank", "final_score"), "final_score", "rank")
    return ranked.withColumn("final_score", r6("final_score"))


@query("win_order_check", with_views("x_targets", body="""
, p AS (SELECT cluster_id AS rank, final_score, lag(final_score) OVER w AS pv, lag(cluster_id) OVER w AS pr FROM x_targets WINDOW w AS (ORDER BY cluster_id, protein_id))
SELECT count(*) AS n_rows, count(*) FILTER (final_score > pv) AS value_rises, count(*) FILTER (rank <= pr) AS rank_repeats FROM p"""))
def win_order_check(spark, sf):
    return windows.order_violations(x_targets(spark, sf), "cluster_id", "final_score", "protein_id")


@query("win_context_budget", """
WITH r AS (SELECT source, doc_id, n_chars, row_number() OVER w AS place, sum(n_chars) OVER w AS used FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING)),
o AS (SELECT source, min(place) AS stop FROM r WHERE used > 24000 AND place > 1 GROUP BY source)
SELECT r.source, doc_id, place, CAST(used AS BIGINT) AS used FROM r LEFT JOIN o ON r.source = o.source WHERE stop IS NULL OR place < stop""")
def win_context_budget(spark, sf):
    rows = tab(spark, sf, "documents").select("source", "doc_id", "n_chars")
    packed = windows.pack_context(rows, ["source"], [F.col("n_chars").desc(), F.col("doc_id")], "n_chars")
    return packed.select("source", "doc_id", "place", big("used").alias("used"))
