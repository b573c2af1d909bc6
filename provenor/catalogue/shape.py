"""Checked queries for projections and reshaping."""

from pyspark.sql import functions as F

from provenor.catalogue.base import money, query, r6, tab, with_views, x_expr, x_targets
from provenor.functions import extract_id, id_parts, label_group, log2p1, neg_log10, node_size, norm_key
from provenor.operators import shape


@query("prj_typed", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS customer, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders""")
def prj_typed(spark, sf):
    raw = tab(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("a"),
        F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("b.1"),
        F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("o_totalprice").cast("string")).alias("c"),
    )
    return shape.project_typed(raw, {"id": ("a", "bigint"), "customer": ("b.1", "bigint"), "price": ("c", "double")})


@query("prj_drop_rename", "SELECT c_custkey AS key, c_name, c_nationkey FROM customer")
def prj_drop_rename(spark, sf):
    return shape.drop_rename(tab(spark, sf, "customer"), ["c_acctbal", "c_mktsegment"], {"c_custkey": "key"})


@query("prj_id_parts", """
SELECT 'ENSG' || c_custkey || '.' || (c_custkey % 9) || CASE WHEN c_nationkey % 2 = 0 THEN '_PAR_Y' ELSE '' END AS gene_id,
       c_nationkey % 2 = 0 AS is_par_y, 'ENSG' || c_custkey AS gene_id_base FROM customer""")
def prj_id_parts(spark, sf):
    raw = tab(spark, sf, "customer").select(F.concat(
        F.lit("ENSG"), "c_custkey", F.lit("."), F.col("c_custkey") % 9, F.when(F.col("c_nationkey") % 2 == 0, "_PAR_Y").otherwise("")
    ).alias("gene_id"))
    flag, base = id_parts("gene_id")
    return raw.select("gene_id", flag.alias("is_par_y"), base.alias("gene_id_base"))


@query("prj_extract_id", """
SELECT page_id, nullif(regexp_extract(url, 'https?://([^/:?#]+)', 1), '') AS host, nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') AS page_no FROM pages""")
def prj_extract_id(spark, sf):
    return tab(spark, sf, "pages").select(
        "page_id", extract_id("url", r"https?://([^/:?#]+)").alias("host"), extract_id("url", r"[?&]page=([0-9]+)").alias("page_no")
    )


@query("prj_norm_key", """
SELECT p_partkey, upper(trim('  ' || p_name || ' ')) AS trimmed, upper(regexp_replace(p_name || ' ' || p_brand, '\\s+', '', 'g')) AS stripped FROM part""")
def prj_norm_key(spark, sf):
    return tab(spark, sf, "part").select(
        "p_partkey", norm_key(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("trimmed"),
        norm_key(F.concat_ws(" ", "p_name", "p_brand"), strip_inner=True).alias("stripped"),
    )


@query("prj_keyword_group", """
WITH t AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'Solid Tissue Normal' WHEN 1 THEN 'Primary Tumor' WHEN 2 THEN 'Metastatic' WHEN 3 THEN NULL ELSE 'Primary' END AS a,
                  CASE WHEN p_size % 3 = 0 THEN 'normal ' || p_type ELSE p_type END AS b FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(lower(concat_ws(' ', a, b)), 'normal') THEN 'normal'
  WHEN regexp_matches(lower(concat_ws(' ', a, b)), 'tumou?r|recurrent|metastatic|primary') THEN 'tumor' ELSE 'other' END AS grp FROM t""")
def prj_keyword_group(spark, sf):
    k = F.col("p_size") % 5
    a = F.when(k == 0, "Solid Tissue Normal").when(k == 1, "Primary Tumor").when(k == 2, "Metastatic").when(k == 4, "Primary")
    b = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("normal "), "p_type")).otherwise(F.col("p_type"))
    return tab(spark, sf, "part").select("p_partkey", label_group(a, b).alias("grp"))


@query("prj_band", """
SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'medium' ELSE 'low' END AS band,
       CASE WHEN o_totalprice - 200000 > 0 THEN 'Upregulated' WHEN o_totalprice - 200000 < 0 THEN 'Downregulated' ELSE 'No change' END AS direction,
       CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'high' WHEN o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 THEN 'medium' ELSE 'low' END AS confidence FROM orders""")
def prj_band(spark, sf):
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    rows = shape.band(tab(spark, sf, "orders"), "band", [(price >= 300000, "high"), (price >= 100000, "medium")], "low")
    return rows.select(
        "o_orderkey", "band", shape.direction(price - 200000).alias("direction"),
        shape.confidence(F.when(key % 2 == 0, key), F.when(key % 3 == 0, key)).alias("confidence"),
    )


@query("prj_fill_defaults", """
SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(total, 0.0) AS total
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""")
def prj_fill_defaults(spark, sf):
    per = tab(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), money("o_totalprice").alias("total"))
    joined = tab(spark, sf, "customer").select("c_custkey").join(per, "c_custkey", "left")
    return shape.fill_defaults(joined, {"n_orders": "bigint", "total": "double"})


@query("prj_safe_flag", """
SELECT l_returnflag, coalesce(abs(l_discount - 0.05) >= 0.03 AND nullif(l_tax, 0) < 0.05, false) AS flag, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def prj_safe_flag(spark, sf):
    cond = (F.abs(F.col("l_discount") - 0.05) >= 0.03) & (F.nullif(F.col("l_tax"), F.lit(0.0)) < 0.05)
    rows = tab(spark, sf, "lineitem").select("l_returnflag", shape.safe_flag(cond).alias("flag"))
    return rows.groupBy("l_returnflag", "flag").agg(F.count(F.lit(1)).alias("n"))


@query("prj_log_transforms", """
WITH p AS (SELECT p_partkey, p_retailprice AS v, CASE WHEN p_size = 50 THEN NULL ELSE (p_size - 1) / 1e40 END AS p FROM part)
SELECT p_partkey, round(log2(v + 1), 6) AS log2p1, round(ln(1 + v), 6) AS log1p,
       CASE WHEN p <= 0 THEN 300.0 WHEN p IS NOT NULL THEN round(-log10(CASE WHEN p > 0 THEN p END), 6) END AS neg_log,
       CASE WHEN p <= 0 THEN 39.5 WHEN p IS NOT NULL THEN round(least(39.5, -log10(CASE WHEN p > 0 THEN p END)), 6) END AS neg_log_plot FROM p""")
def prj_log_transforms(spark, sf):
    rows = tab(spark, sf, "part").select(
        "p_partkey", "p_retailprice", F.when(F.col("p_size") != 50, (F.col("p_size") - 1) / 1e40).alias("p")
    )
    return rows.select(
        "p_partkey", r6(log2p1("p_retailprice")).alias("log2p1"), r6(F.log1p("p_retailprice")).alias("log1p"),
        r6(neg_log10("p")).alias("neg_log"), r6(neg_log10("p", plot_cap=39.5)).alias("neg_log_plot"),
    )


@query("prj_node_size", """
SELECT o_orderkey, round(least(26.0, 7 + ln(1 + o_totalprice / (1 + o_orderkey % 500)) * 2.2), 6) AS node_size FROM orders""")
def prj_node_size(spark, sf):
    weight = F.col("o_totalprice") / (1 + F.col("o_orderkey") % 500)
    return tab(spark, sf, "orders").select("o_orderkey", r6(node_size(weight)).alias("node_size"))


@query("prj_literals", "SELECT s_suppkey, 'cohort' AS mode, 'Not mapped' AS status FROM supplier")
def prj_literals(spark, sf):
    return shape.with_literals(tab(spark, sf, "supplier").select("s_suppkey"), mode="cohort", status="Not mapped")


@query("prj_nested_detail", with_views("x_targets", body="""
SELECT '{"gene_name":"' || gene_name || '","protein_id":"' || protein_id || '","rank":' || rank || '}' AS identity,
       '{"deg_direction":"' || deg_direction || '","support_level":"' || geo_support_level || '"}' AS evidence,
       '{"cluster_id":' || cluster_id || ',"candidate_group":"' || candidate_group || '"}' AS clustering FROM x_targets"""))
def prj_nested_detail(spark, sf):
    nested = shape.nest(x_targets(spark, sf), {
        "identity": {c: F.col(c) for c in ("gene_name", "protein_id", "rank")},
        "evidence": {"deg_direction": F.col("deg_direction"), "support_level": F.col("geo_support_level")},
        "clustering": {c: F.col(c) for c in ("cluster_id", "candidate_group")},
    })
    return nested.select(*[F.to_json(c).alias(c) for c in nested.columns])


@query("prj_select_existing", "SELECT s_name, s_suppkey FROM supplier")
def prj_select_existing(spark, sf):
    return shape.select_existing(tab(spark, sf, "supplier"), ["s_name", "s_phone", "s_suppkey"])


@query("rsh_wide_groups_to_long", """
SELECT o_custkey AS case_id, 'S' || o_orderkey AS sample_id, o_orderpriority AS sample_type, o_orderstatus AS tissue_type FROM orders
UNION ALL SELECT o_custkey, 'T' || o_orderkey, o_orderstatus, NULL FROM orders WHERE o_totalprice > 100000""")
def rsh_wide_groups_to_long(spark, sf):
    wide = tab(spark, sf, "orders").select(
        F.col("o_custkey").alias("case_id"),
        F.concat(F.lit("S"), "o_orderkey").alias("samples.0.sample_id"), F.col("o_orderpriority").alias("samples.0.sample_type"),
        F.col("o_orderstatus").alias("samples.0.tissue_type"),
        F.when(F.col("o_totalprice") > 100000, F.concat(F.lit("T"), "o_orderkey")).otherwise(" ").alias("samples.1.sample_id"),
        F.col("o_orderstatus").alias("samples.1.sample_type"),
    )
    return shape.wide_groups_to_long(wide, "case_id", ["sample_id", "sample_type", "tissue_type"])


@query("rsh_unpivot", """
SELECT l_suppkey, measure, count(*) AS n, round(avg(amount), 6) AS mean FROM (
  SELECT l_suppkey, 'l_quantity' AS measure, l_quantity AS amount FROM lineitem
  UNION ALL SELECT l_suppkey, 'l_discount', l_discount FROM lineitem WHERE l_linenumber <> 2
  UNION ALL SELECT l_suppkey, 'l_tax', l_tax FROM lineitem) GROUP BY 1, 2""")
def rsh_unpivot(spark, sf):
    rows = tab(spark, sf, "lineitem").select(
        "l_suppkey", "l_quantity", F.when(F.col("l_linenumber") == 2, "bad").otherwise(F.col("l_discount").cast("string")).alias("l_discount"), "l_tax"
    )
    long = shape.melt(rows, ["l_suppkey"], ["l_quantity", "l_discount", "l_tax"], "measure", "amount")
    return long.groupBy("l_suppkey", "measure").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("amount")).alias("mean"))


@query("rsh_conditional_pivot", with_views("x_expr", body="""
SELECT gene, round(avg(log_value) FILTER (grp = 'case'), 6) AS mean_log_case, round(avg(log_value) FILTER (grp = 'control'), 6) AS mean_log_control,
       CAST(sum(n) FILTER (grp = 'case') AS BIGINT) AS total_case, CAST(sum(n) FILTER (grp = 'control') AS BIGINT) AS total_control FROM x_expr GROUP BY gene"""))
def rsh_conditional_pivot(spark, sf):
    per = x_expr(spark, sf).groupBy("gene", "grp").agg(r6(F.avg("log_value")).alias("mean_log"), F.sum("n").alias("total"))
    return shape.pivot_groups(per, ["gene"], "grp", {"case": "case", "control": "control"}, ["mean_log", "total"])


@query("rsh_heatmap", with_views("x_expr", body="""
, g AS (SELECT gene, CAST(sum(n) AS BIGINT) AS total FROM x_expr GROUP BY gene),
lab AS (SELECT gene, row_number() OVER (ORDER BY total DESC, gene) AS row_no FROM g QUALIFY row_no <= 24),
col AS (SELECT grp, sample_id, row_number() OVER (PARTITION BY grp ORDER BY sample_id) AS col_no FROM (SELECT DISTINCT grp, sample_id FROM x_expr) QUALIFY col_no <= 8),
cell AS (SELECT gene, sample_id, max(log_value) AS cell FROM x_expr WHERE gene IN (SELECT gene FROM lab) AND sample_id IN (SELECT sample_id FROM col) GROUP BY 1, 2)
SELECT CAST(row_no AS INTEGER) AS row_no, lab.gene,
       CAST(row_number() OVER (PARTITION BY lab.gene ORDER BY CASE col.grp WHEN 'other' THEN 1 WHEN 'control' THEN 2 ELSE 3 END, col_no) AS INTEGER) AS cell_no, col.grp, col.sample_id, round(cell.cell, 6) AS cell
FROM lab CROSS JOIN col LEFT JOIN cell ON cell.gene = lab.gene AND cell.sample_id = col.sample_id"""))
def rsh_heatmap(spark, sf):
    expr = x_expr(spark, sf)
    totals = expr.groupBy("gene").agg(F.sum("n").alias("total"))
    rows = shape.heat_map(expr, "gene", "sample_id", "grp", "log_value", ["other", "control", "case"], [F.col("total").desc(), F.col("gene")], totals, n_cols=8)
    return rows.select("row_no", "gene", F.inline("cells")).select("row_no", "gene", F.col("cell_no").cast("int").alias("cell_no"), "grp", "sample_id", r6("cell").alias("cell"))


@query("rsh_score_components", """
WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE s_acctbal / 10000 END AS e, s_nationkey / 25.0e0 AS n, 0.25e0 AS c FROM supplier)
SELECT s_suppkey, CAST(1 AS INTEGER) AS component_no, 'Expression score' AS name, coalesce(e, 0) AS raw_score, 0.5e0 AS weight, round(coalesce(e, 0) * 0.5, 4) AS weighted_score FROM s
UNION ALL SELECT s_suppkey, 2, 'Protein network score', n, 0.3e0, round(n * 0.3, 4) FROM s
UNION ALL SELECT s_suppkey, 3, 'STRING confidence score', c, 0.2e0, round(c * 0.2, 4) FROM s""")
def rsh_score_components(spark, sf):
    rows = tab(spark, sf, "supplier").select(
        "s_suppkey", F.when(F.col("s_suppkey") % 6 != 0, F.col("s_acctbal") / 10000).alias("e"),
        (F.col("s_nationkey") / 25.0).alias("n"), F.lit(0.25).alias("c"),
    )
    return shape.explode_components(rows, ["s_suppkey"], {
        "Expression score": ("e", 0.5), "Protein network score": ("n", 0.3), "STRING confidence score": ("c", 0.2),
    })
