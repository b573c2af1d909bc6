"""Checked queries for filters."""

from pyspark.sql import functions as F

from provenor.catalogue.base import big, query, r6, tab, with_views, x_diff, x_edges, x_targets
from provenor.functions import neg_log10
from provenor.operators import filters


@query("flt_regex", "SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '^Customer#0+[0-9]*7$')")
def flt_regex(spark, sf):
    return filters.keep_matching(tab(spark, sf, "customer").select("c_custkey", "c_name"), "c_name", "^Customer#0+[0-9]*7$")


@query("flt_class", "SELECT p_partkey, p_type FROM part WHERE p_type = 'ECONOMY' AND NOT p_size > 25")
def flt_class(spark, sf):
    rows = tab(spark, sf, "part").select("p_partkey", "p_type", (F.col("p_size") > 25).alias("is_large"))
    return filters.filter_class(rows, "p_type", "ECONOMY", "is_large")


@query("flt_not_blank", """
SELECT doc_id, count(*) AS n_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(trim(line)) > 0 GROUP BY doc_id""")
def flt_not_blank(spark, sf):
    lines = tab(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return filters.keep_present(lines, "line").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))


@query("flt_isin", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def flt_isin(spark, sf):
    return filters.filter_in(tab(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["1-urgent", "5-Low"])


@query("flt_threshold", with_views("x_edges", body="""
SELECT dst, count(*) AS n_edges, count(*) FILTER (weight >= 0.7) AS n_high FROM x_edges WHERE weight >= 0.4 GROUP BY dst"""))
def flt_threshold(spark, sf):
    return filters.min_weight(x_edges(spark, sf), "weight").groupBy("dst").agg(
        F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("weight") >= 0.7).alias("n_high")
    )


_SEARCH = dict(
    search="00001", equals={"geo_support_level": "strong geo support", "deg_direction": "UPREGULATED"}, contains={"candidate_group": "mobi"},
    min_score=("final_score", 0.5),
)
_SEARCH_SQL = """
upper(gene_name) LIKE '%00001%' AND lower(geo_support_level) = 'strong geo support' AND lower(deg_direction) = 'upregulated'
AND lower(candidate_group) LIKE '%mobi%' AND final_score >= 0.5"""


@query("flt_candidate_search", with_views("x_targets", body=f"""
SELECT rank, gene_name, protein_id, round(final_score, 6) AS final_score, (SELECT count(*) FROM x_targets WHERE {_SEARCH_SQL}) AS total
FROM x_targets WHERE {_SEARCH_SQL} ORDER BY rank LIMIT 10 OFFSET 2"""))
def flt_candidate_search(spark, sf):
    hits = filters.search_targets(x_targets(spark, sf), "rank", limit=10, offset=2, **_SEARCH)
    return hits.select("rank", "gene_name", "protein_id", r6("final_score").alias("final_score"), "total")


@query("flt_candidate_search_total", with_views("x_targets", body="""
SELECT count(*) AS total FROM x_targets WHERE (upper(gene_name) LIKE '%7%' OR protein_id LIKE '%7%' OR ensp_id LIKE '%7%') AND cluster_id = 3"""))
def flt_candidate_search_total(spark, sf):
    return filters.search_total(x_targets(spark, sf), search="7", cluster=("cluster_id", 3))


@query("flt_lookup", with_views("x_targets", body="SELECT rank, gene_name, protein_id FROM x_targets WHERE protein_id = 'C77' OR gene_name = 'C77' OR ensp_id = 'C77' ORDER BY rank LIMIT 1"))
def flt_lookup(spark, sf):
    return filters.lookup(x_targets(spark, sf), "c77", ["protein_id", "gene_name", "ensp_id"], [F.col("rank")]).select("rank", "gene_name", "protein_id")


_PLOT = dict(numbers=["p_value", "effect", "height"], flag="is_different", direction="direction", rank="rank", effect="effect", tie="gene")


@query("flt_plot_ready", with_views("x_diff", body="""
, d AS (SELECT gene, effect, p_value, is_deg, direction, CASE WHEN ascii(substr(gene, 1, 1)) % 2 = 0 THEN length(gene) END AS rank FROM x_diff WHERE p_value IS NOT NULL),
a AS (SELECT 'all' AS view, gene, rank FROM d ORDER BY rank NULLS LAST, abs(effect) DESC, gene LIMIT 100)
SELECT view, gene, CAST(rank AS BIGINT) AS rank FROM a
UNION ALL SELECT 'up', gene, rank FROM d WHERE is_deg AND direction = 'Upregulated'
UNION ALL SELECT 'down', gene, rank FROM d WHERE is_deg AND direction = 'Downregulated'
UNION ALL SELECT 'not', gene, rank FROM d WHERE NOT is_deg"""))
def flt_plot_ready(spark, sf):
    rows = x_diff(spark, sf).select(
        "gene", "effect", "p_value", "is_different", "direction", neg_log10("p_value", plot_cap=60.0).alias("height"),
        F.when(F.ascii(F.substring("gene", 1, 1)) % 2 == 0, F.length("gene")).alias("rank"),
    )
    views = [filters.plot_ready(rows, view=v, **_PLOT).select(F.lit(v).alias("view"), "gene", big("rank").alias("rank")) for v in ("all", "up", "down", "not")]
    return views[0].unionByName(views[1]).unionByName(views[2]).unionByName(views[3])
