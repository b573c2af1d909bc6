"""Checked queries for joins and graph operators."""

from pyspark.sql import functions as F

from provenor.catalogue.base import money, query, r6, tab, with_views, x_edges, x_expr, x_map, x_qc, x_targets
from provenor.operators import graph, joins
from provenor.plans.clusters import enrich_ranking


@query("jon_left_enrich", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS own, c_custkey IS NOT NULL AS known,
       coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END, c_mktsegment, 'other') AS label
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 20) ON o_custkey = c_custkey""")
def jon_left_enrich(spark, sf):
    o = tab(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("own"))
    dim = tab(spark, sf, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"), F.lit(True).alias("known"))
    out = joins.enrich_left(o.withColumn("other", F.lit("other")), dim, ["key"], {"label": ["own", "segment", "other"]})
    return out.select("o_orderkey", "own", F.coalesce("known", F.lit(False)).alias("known"), "label")


@query("jon_full_outer_presence", """
SELECT coalesce(a.k, b.k) AS key, a.n_lines, b.k IS NOT NULL AS has_order
FROM (SELECT l_orderkey AS k, count(*) AS n_lines FROM lineitem GROUP BY 1) a
FULL OUTER JOIN (SELECT o_orderkey * 2 AS k FROM orders) b ON a.k = b.k""")
def jon_full_outer_presence(spark, sf):
    lines = tab(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count(F.lit(1)).alias("n_lines"))
    orders = tab(spark, sf, "orders").select((F.col("o_orderkey") * 2).alias("key"))
    return joins.reconcile(lines, orders, "key", "has_order")


@query("jon_fact_dim", """
SELECT p_brand, l_returnflag, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey GROUP BY p_brand, l_returnflag""")
def jon_fact_dim(spark, sf):
    fact = tab(spark, sf, "lineitem").select("l_partkey", "l_returnflag", "l_extendedprice", "l_orderkey", "l_linenumber")
    dim = tab(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    joined = joins.attach_dim(fact, dim, ["l_partkey"], salts=4)
    return joined.groupBy("p_brand", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), money("l_extendedprice").alias("total"))


@query("jon_keep_list", with_views("x_qc", body="""
SELECT sample_id, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS total FROM x_expr
WHERE sample_id IN (SELECT sample_id FROM x_qc WHERE n_detected > 200) GROUP BY sample_id"""))
def jon_keep_list(spark, sf):
    kept = joins.keep_members(x_expr(spark, sf), x_qc(spark, sf).where("n_detected > 200"), ["sample_id"], salts=4)
    return kept.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("total"))


@query("jon_norm_key_map", with_views("x_map", "x_moments", body="""
, g AS (SELECT DISTINCT gene, upper(trim(gene)) AS name FROM x_moments),
m AS (SELECT DISTINCT protein_id, confidence, upper(trim(coalesce(CASE WHEN trim(symbol_norm) <> '' THEN symbol_norm END, CASE WHEN trim(symbol) <> '' THEN symbol END))) AS name FROM x_map)
SELECT DISTINCT gene, protein_id, confidence FROM g JOIN m ON g.name = m.name WHERE m.name <> ''"""))
def jon_norm_key_map(spark, sf):
    genes = x_expr(spark, sf).select("gene").distinct()
    names = x_map(spark, sf).select("protein_id", "confidence", "symbol_norm", "symbol")
    return joins.map_entities(genes, names, "gene", ["symbol_norm", "symbol"])


@query("jon_both_ends", with_views("x_edges", "x_map", body="""
SELECT s.confidence AS confidence_src, d.s_nationkey AS confidence_dst, count(*) AS n, round(sum(weight), 4) AS weight
FROM x_edges e LEFT JOIN x_map s ON e.src = s.protein_id LEFT JOIN (SELECT 'S' || s_suppkey AS id, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier) d ON e.dst = d.id
GROUP BY 1, 2"""))
def jon_both_ends(spark, sf):
    named = x_map(spark, sf).select(F.col("protein_id").alias("node"), "confidence")
    suppliers = tab(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("node"), F.col("s_nationkey").cast("string").alias("confidence"))
    ends = joins.attach_ends(x_edges(spark, sf), named.unionByName(suppliers), "node", "src", "dst")
    return ends.groupBy("confidence_src", "confidence_dst").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("weight"), 4).alias("weight"))


_NODES_SQL = "nodes AS (SELECT 'P' || p_partkey AS node, p_brand AS brand FROM part WHERE p_size <= 10 UNION ALL SELECT 'S' || s_suppkey, 'supplier' FROM supplier WHERE s_nationkey < 5)"


def _nodes(spark, sf):
    part = tab(spark, sf, "part").where("p_size <= 10").select(F.concat(F.lit("P"), "p_partkey").alias("node"), F.col("p_brand").alias("brand"))
    supp = tab(spark, sf, "supplier").where("s_nationkey < 5").select(F.concat(F.lit("S"), "s_suppkey").alias("node"), F.lit("supplier").alias("brand"))
    return part.unionByName(supp)


@query("jon_incident_edges", with_views("x_edges", body=f"""
, {_NODES_SQL} SELECT src, dst, score FROM x_edges WHERE src IN (SELECT node FROM nodes) OR dst IN (SELECT node FROM nodes)"""))
def jon_incident_edges(spark, sf):
    return graph.incident_edges(x_edges(spark, sf).select("src", "dst", "score"), _nodes(spark, sf), "node", "src", "dst")


@query("jon_induced_subgraph", with_views("x_edges", body=f"""
, {_NODES_SQL} SELECT src, dst, s.brand AS brand_src, d.brand AS brand_dst, score FROM x_edges JOIN nodes s ON src = s.node JOIN nodes d ON dst = d.node WHERE weight >= 0.4"""))
def jon_induced_subgraph(spark, sf):
    sub = graph.induced_subgraph(x_edges(spark, sf), _nodes(spark, sf), "node", "src", "dst", "weight", attrs=["brand"])
    return sub.select("src", "dst", "brand_src", "brand_dst", "score")


@query("jon_left_anti", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def jon_left_anti(spark, sf):
    ref = tab(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.missing(tab(spark, sf, "customer").select("c_custkey", "c_name"), ref, ["c_custkey"])


@query("jon_feature_assembly", """
SELECT c_custkey, coalesce(n_orders, 0) AS n_orders, coalesce(n_events, 0) AS n_events, coalesce(top_value, 0.0) AS top_value FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) ON o_custkey = c_custkey
LEFT JOIN (SELECT user_id, count(*) AS n_events, max(value) AS top_value FROM events GROUP BY 1) ON user_id = c_custkey""")
def jon_feature_assembly(spark, sf):
    n = F.count(F.lit(1))
    per_orders = tab(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(n.alias("n_orders"))
    per_events = tab(spark, sf, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(n.alias("n_events"), F.max("value").alias("top_value"))
    return joins.assemble(tab(spark, sf, "customer").select("c_custkey"), "c_custkey", [per_orders, per_events], {"n_orders": 0, "n_events": 0, "top_value": 0.0})


@query("jon_rank_enrichment", with_views("x_targets", body="""
, sup AS (SELECT upper(trim(c_name)) AS name, count(o_orderkey) AS n_orders FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1),
clu AS (SELECT 'C' || user_id AS protein_id, count(*) AS n_events FROM events GROUP BY 1)
SELECT rank, gene_name, t.protein_id, n_orders, n_events FROM x_targets t LEFT JOIN sup ON upper(trim(gene_name)) = sup.name LEFT JOIN clu ON clu.protein_id = t.protein_id"""))
def jon_rank_enrichment(spark, sf):
    names = tab(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    support = (
        tab(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey").join(names, "k")
        .groupBy(F.upper(F.trim("c_name")).alias("gene_name_norm")).agg(F.count("o_orderkey").alias("n_orders"))
    )
    clusters = tab(spark, sf, "events").groupBy(F.concat(F.lit("C"), "user_id").alias("protein_id")).agg(F.count(F.lit(1)).alias("n_events"))
    return enrich_ranking(x_targets(spark, sf).select("rank", "gene_name", "protein_id"), support, clusters)


@query("jon_label_lookup", """
SELECT vec_id, CASE label WHEN 0 THEN 'first' WHEN 1 THEN 'second' ELSE 'Cluster ' || label END AS meaning FROM embeddings""")
def jon_label_lookup(spark, sf):
    rows = tab(spark, sf, "embeddings").select("vec_id", "label")
    return joins.attach_label(rows, {0: "first", 1: "second"}, "label", "meaning", F.concat(F.lit("Cluster "), "label")).drop("label")


@query("jon_dedup_attr", """
SELECT s_suppkey, first_flag FROM supplier LEFT JOIN (SELECT l_suppkey, min(l_returnflag || l_linestatus) AS first_flag FROM lineitem GROUP BY 1) ON s_suppkey + 3 = l_suppkey""")
def jon_dedup_attr(spark, sf):
    dim = tab(spark, sf, "lineitem").select((F.col("l_suppkey") - 3).alias("s_suppkey"), F.concat("l_returnflag", "l_linestatus").alias("first_flag"))
    return joins.attach_one(tab(spark, sf, "supplier").select("s_suppkey"), dim, "s_suppkey", "first_flag")


def _wide(spark, sf, cols):
    """Mean price per brand, one text column per supplier nation."""
    supp = tab(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample_id"), F.concat(F.lit(" n"), "s_nationkey").alias("nation"))
    per = x_expr(spark, sf).join(supp, "sample_id").groupBy("gene_type", "gene", "nation").agg(F.avg("value").alias("v"))
    return per.groupBy("gene").pivot("nation", [f" n{i}" for i in cols]).agg(F.max("v").cast("string"))


@query("jon_header_match", "SELECT DISTINCT 'N' || s_nationkey AS sample_id FROM supplier WHERE s_nationkey < 12")
def jon_header_match(spark, sf):
    meta = tab(spark, sf, "supplier").where("s_nationkey < 12").select(F.concat(F.lit("n"), "s_nationkey", F.lit(" ")).alias("Array"))
    return joins.header_members(_wide(spark, sf, range(25)), meta, ["gene"], "Array")


@query("jon_left_semi", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def jon_left_semi(spark, sf):
    keys = tab(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return joins.keep_members(tab(spark, sf, "orders").select("o_orderkey", "o_custkey"), keys, ["o_custkey"], salts=3)


@query("jon_global_stats", """
SELECT o_orderkey, round(o_totalprice - (SELECT min(o_totalprice) FROM orders), 2) AS above_min, (SELECT count(*) FROM orders) AS n FROM orders""")
def jon_global_stats(spark, sf):
    rows = joins.with_global_stats(tab(spark, sf, "orders").select("o_orderkey", "o_totalprice"), {"lo": F.min("o_totalprice"), "n": F.count(F.lit(1))})
    return rows.select("o_orderkey", r6(F.col("o_totalprice") - F.col("lo"), 2).alias("above_min"), "n")


@query("jon_highlight", with_views("x_targets", body="""
SELECT c_custkey, t.rank, coalesce(t.rank <= 20, false) AS is_top FROM customer LEFT JOIN (SELECT upper(trim(gene_name)) AS name, min(rank) AS rank FROM x_targets WHERE cluster_id < 10 GROUP BY 1) t ON upper(trim(c_name)) = t.name"""))
def jon_highlight(spark, sf):
    ranks = x_targets(spark, sf).where("cluster_id < 10").select(F.lower("gene_name").alias("gene_name"), "rank")
    points = tab(spark, sf, "customer").select("c_custkey", F.concat(F.lit(" "), "c_name").alias("gene_name"))
    return joins.highlight(points, ranks, "gene_name", "rank", 20, "is_top").drop("gene_name")


@query("jon_backfill", with_views("x_targets", body="""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'own' || c_custkey ELSE t.protein_id END AS protein_id,
       'No matching GEO tumor-cohort expression entry for this candidate gene in the support mart.' AS reason
FROM customer LEFT JOIN (SELECT * FROM x_targets WHERE cluster_id <> 4) t ON t.gene_name = c_name"""))
def jon_backfill(spark, sf):
    rows = tab(spark, sf, "customer").select(
        "c_custkey", F.col("c_name").alias("gene_name"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("own"), "c_custkey")).alias("protein_id")
    )
    ref = x_targets(spark, sf).where("cluster_id <> 4")
    return joins.backfill(rows, ref, "gene_name", "protein_id", "reason").drop("gene_name")


@query("jon_ego_network", with_views("x_edges", body="""
, n AS (SELECT 'P' || p_partkey AS node, p_partkey + 1 AS rank, p_type FROM part UNION ALL SELECT 'S' || s_suppkey, s_suppkey + 1, 'SUPPLIER' FROM supplier),
c AS (SELECT * FROM n ORDER BY rank, node LIMIT 400), k AS (SELECT * FROM c WHERE p_type <> 'SMALL'),
a AS (SELECT * FROM k WHERE node = 'S3' OR node IN (SELECT src FROM x_edges WHERE dst = 'S3') OR node IN (SELECT dst FROM x_edges WHERE src = 'S3'))
SELECT 'node' AS kind, node AS a, p_type AS b FROM a
UNION ALL SELECT 'edge', src, dst FROM x_edges WHERE weight >= 0.4 AND src IN (SELECT node FROM a) AND dst IN (SELECT node FROM a)"""))
def jon_ego_network(spark, sf):
    part = tab(spark, sf, "part").select(F.concat(F.lit("P"), "p_partkey").alias("node"), (F.col("p_partkey") + 1).alias("rank"), "p_type")
    supp = tab(spark, sf, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("node"), (F.col("s_suppkey") + 1).alias("rank"), F.lit("SUPPLIER").alias("p_type"))
    nodes, edges = graph.ego_network(
        part.unionByName(supp), x_edges(spark, sf), "node", "S3", "src", "dst", "weight", "rank", 400, keep=F.col("p_type") != "SMALL"
    )
    a = nodes.select(F.lit("node").alias("kind"), F.col("node").alias("a"), F.col("p_type").alias("b"))
    return a.unionByName(edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")))


@query("jon_entity_mentions", """
WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(upper(replace(text, 'ß', 'ss')), '[A-Z0-9_.\\-]+')) AS run FROM documents),
e AS (SELECT run AS name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, run) AS rank FROM (SELECT item_id, unnest(regexp_extract_all(upper(replace(text, 'ß', 'ss')), '[A-Z0-9_.\\-]+')) AS run FROM benchmark) WHERE length(run) >= 3 GROUP BY run),
h AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS mention_no FROM w JOIN e ON w.run = e.name)
SELECT doc_id, name, CAST(mention_no AS INTEGER) AS mention_no FROM h WHERE mention_no <= 12""")
def jon_entity_mentions(spark, sf):
    runs = tab(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.upper("text"), F.lit(r"[A-Z0-9_.\-]+"), F.lit(0))).alias("name"))
    words = runs.where(F.length("name") >= 3).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    found = joins.entity_mentions(tab(spark, sf, "documents"), "doc_id", "text", words, ["name"], "name", [F.col("n").desc()])
    return found.select("doc_id", "name", "mention_no")
