"""Checked queries for sorts, limits and set operations."""

from pyspark.sql import functions as F

from provenor.catalogue.base import big, query, r6, tab, with_views, x_diff, x_edges, x_expr, x_map, x_targets
from provenor.operators import sets, sorting


@query("srt_top_k", with_views("x_diff", body="""
SELECT gene, round(abs(effect), 6) AS abs_effect, direction, CAST(row_number() OVER (ORDER BY abs(effect) DESC, gene) AS INTEGER) AS rank FROM x_diff QUALIFY rank <= 50"""))
def srt_top_k(spark, sf):
    rows = x_diff(spark, sf).select("gene", F.abs("effect").alias("abs_effect"), "direction")
    return sorting.top_k(rows, [F.col("abs_effect").desc(), F.col("gene")], 50).withColumn("abs_effect", r6("abs_effect"))


@query("srt_level_order", with_views("x_targets", body="""
SELECT geo_support_level, count(*) AS n, CAST(CASE geo_support_level WHEN 'Strong GEO support' THEN 1 WHEN 'Moderate GEO support' THEN 2 WHEN 'Limited GEO support' THEN 3 ELSE 5 END AS INTEGER) AS level_no
FROM x_targets GROUP BY 1"""))
def srt_level_order(spark, sf):
    counts = x_targets(spark, sf).groupBy("geo_support_level").agg(F.count(F.lit(1)).alias("n"))
    named = sorting.order_levels(counts, "geo_support_level", ["Strong GEO support", "Moderate GEO support", "Limited GEO support", "None"])
    return named


@query("srt_argmax", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 1")
def srt_argmax(spark, sf):
    return sorting.arg_max(tab(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")), "n", "l_suppkey")


@query("srt_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def srt_page(spark, sf):
    return sorting.page(tab(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 25, 50)


@query("srt_n_per_group", with_views("x_expr", body="""
SELECT grp, sample_id FROM (SELECT DISTINCT grp, sample_id FROM x_expr) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY sample_id) <= 32"""))
def srt_n_per_group(spark, sf):
    return sorting.n_per_group(x_expr(spark, sf).select("grp", "sample_id").distinct(), ["grp"], [F.col("sample_id")], 32)


_MIXED = "CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN '' WHEN c_custkey % 2 = 0 THEN CAST(c_acctbal AS VARCHAR) ELSE c_name END"


@query("srt_mixed", f"""
WITH m AS (SELECT c_custkey, {_MIXED} AS v FROM customer)
SELECT c_custkey, row_number() OVER (ORDER BY v IS NULL OR v = '', try_cast(v AS DOUBLE) IS NULL, try_cast(v AS DOUBLE), lower(CASE WHEN v <> '' THEN v END), c_custkey) AS place FROM m""")
def srt_mixed(spark, sf):
    rows = tab(spark, sf, "customer").select("c_custkey", F.expr(_MIXED.replace("VARCHAR", "STRING")).alias("v"))
    return sorting.global_rank(rows, [*sorting.mixed_order("v"), F.col("c_custkey").asc()], rank="place").select("c_custkey", "place")


@query("set_union_all", """
SELECT 'customer' AS kind, c_custkey AS id FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier UNION ALL SELECT 'part', p_partkey FROM part""")
def set_union_all(spark, sf):
    frames = [
        tab(spark, sf, t).select(F.lit(t).alias("kind"), F.col(c).alias("id"))
        for t, c in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"))
    ]
    return sets.union_all(spark, frames, "kind string, id bigint")


@query("set_both_directions", with_views("x_edges", body="""
SELECT left(node, 1) AS side, count(*) AS n, CAST(sum(score) AS BIGINT) AS score FROM (SELECT src AS node, dst, score FROM x_edges UNION ALL SELECT dst, src, score FROM x_edges) GROUP BY 1"""))
def set_both_directions(spark, sf):
    seen = sets.both_directions(x_edges(spark, sf), "src", "dst")
    return seen.groupBy(F.left("node", F.lit(1)).alias("side")).agg(F.count(F.lit(1)).alias("n"), big(F.sum("score")).alias("score"))


@query("set_union_distinct", with_views("x_edges", "x_map", body="SELECT protein_id FROM x_map UNION SELECT src FROM x_edges UNION SELECT dst FROM x_edges"))
def set_union_distinct(spark, sf):
    return sets.all_nodes(x_edges(spark, sf), "src", "dst", x_map(spark, sf), "protein_id")


@query("set_difference", """
SELECT DISTINCT c_custkey AS id, 'stale' AS state FROM customer WHERE c_custkey NOT IN (SELECT o_custkey * 2 FROM orders)
UNION ALL SELECT DISTINCT o_custkey * 2, 'new' FROM orders WHERE o_custkey * 2 NOT IN (SELECT c_custkey FROM customer)""")
def set_difference(spark, sf):
    want = tab(spark, sf, "orders").select((F.col("o_custkey") * 2).alias("id"))
    return sets.id_diff(tab(spark, sf, "customer").select(F.col("c_custkey").alias("id")), want, "id")


@query("set_upsert", """
SELECT c_custkey AS id, 'current' AS origin FROM customer WHERE c_nationkey < 15 AND NOT c_nationkey > 10
UNION ALL SELECT c_custkey, 'incoming' FROM customer WHERE c_nationkey > 10""")
def set_upsert(spark, sf):
    c = tab(spark, sf, "customer")
    current = c.where("c_nationkey < 15").select(F.col("c_custkey").alias("id"), F.lit("current").alias("origin"))
    incoming = c.where("c_nationkey > 10").select(F.col("c_custkey").alias("id"), F.lit("incoming").alias("origin"))
    return sets.upsert(current, incoming, "id", keep_stale=True)


@query("set_upsert_refresh", """
SELECT c_custkey AS id, 'incoming' AS origin FROM customer WHERE c_nationkey > 10""")
def set_upsert_refresh(spark, sf):
    """A full refresh: rows that the incoming table lacks are removed."""
    c = tab(spark, sf, "customer")
    current = c.where("c_nationkey < 15").select(F.col("c_custkey").alias("id"), F.lit("current").alias("origin"))
    incoming = c.where("c_nationkey > 10").select(F.col("c_custkey").alias("id"), F.lit("incoming").alias("origin"))
    return sets.upsert(current, incoming, "id")
