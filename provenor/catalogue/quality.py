"""Checked queries for data-quality operators."""

from pyspark.sql import functions as F

from provenor.catalogue.base import query, r6, tab, with_views, x_diff, x_edges, x_qc, x_targets
from provenor.operators import quality
from provenor.operators.aggregates import shares
from provenor.operators.sorting import global_rank
from provenor.session import working_path
from provenor.sinks.tables import write_table


_EXPECTED = {
    "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_acctbal": "double"},
    "part": {"p_partkey": "bigint", "p_name": "bigint"},
    "orders": {"o_orderkey": "bigint", "o_no_such": "string"},
}


@query("dqc_schema", """
WITH want AS (SELECT * FROM (VALUES ('supplier', 's_suppkey', 'bigint'), ('supplier', 's_name', 'string'), ('supplier', 's_acctbal', 'double'), ('part', 'p_partkey', 'bigint'),
  ('part', 'p_name', 'bigint'), ('orders', 'o_orderkey', 'bigint'), ('orders', 'o_no_such', 'string')) v(t, c, k)),
have AS (SELECT 'supplier' AS t, column_name AS c, column_type AS k FROM (DESCRIBE supplier) UNION ALL SELECT 'part', column_name, column_type FROM (DESCRIBE part)
  UNION ALL SELECT 'orders', column_name, column_type FROM (DESCRIBE orders)),
n AS (SELECT 'supplier' AS t, count(*) AS n_rows FROM supplier UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'orders', count(*) FROM orders)
SELECT w.t AS table_name, n_rows, bool_and(h.c IS NOT NULL) AS columns_ok,
       bool_and(coalesce(CASE h.k WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'INTEGER' THEN 'int' END = w.k, false)) AS types_ok
FROM want w LEFT JOIN have h ON h.t = w.t AND h.c = w.c JOIN n ON n.t = w.t GROUP BY w.t, n_rows""")
def dqc_schema(spark, sf):
    """Which tables have the columns, and the types, that are asked of them; one lacks a column, one has another type."""
    def passes(check, *args) -> bool:
        try:
            check(*args)
        except ValueError:
            return False
        return True

    parts = []
    for name, want in _EXPECTED.items():
        df = tab(spark, sf, name)
        present = df.select(*[c for c in want if c in df.columns])
        has, typed = passes(quality.require_columns, df, list(want)), passes(quality.require_schema, present, list(want), want)
        parts.append(df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", F.lit(has).alias("columns_ok"), F.lit(typed).alias("types_ok")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("dqc_dup_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dqc_dup_keys(spark, sf):
    return quality.dup_keys(tab(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("dqc_nulls", with_views("x_targets", body="""
SELECT 'gene_name' AS check, count(*) FILTER (gene_name IS NULL) AS n_bad FROM x_targets
UNION ALL SELECT 'final_score', count(*) FILTER (final_score IS NULL OR final_score < 0.1) FROM x_targets
UNION ALL SELECT 'any', count(*) FILTER (gene_name IS NULL OR final_score IS NULL OR final_score < 0.1) FROM x_targets"""))
def dqc_nulls(spark, sf):
    rows = x_targets(spark, sf).withColumn("final_score", F.when(F.col("final_score") < 0.1, float("nan")).otherwise(F.col("final_score")))
    return quality.null_rows(rows, ["gene_name", "final_score"])


@query("dqc_ranges", with_views("x_edges", body="""
SELECT 'score' AS check, count(*) FILTER (score < 100 OR score > 900) AS n_bad FROM x_edges UNION ALL SELECT 'weight', count(*) FILTER (weight < 0 OR weight > 1) FROM x_edges"""))
def dqc_ranges(spark, sf):
    return quality.out_of_range(x_edges(spark, sf), {"score": (100, 900), "weight": (0.0, 1.0)})


@query("dqc_orphans", "SELECT DISTINCT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey * 2 FROM orders)")
def dqc_orphans(spark, sf):
    ref = tab(spark, sf, "orders").select((F.col("o_custkey") * 2).alias("key"))
    return quality.orphans(tab(spark, sf, "customer").select(F.col("c_custkey").alias("key")), ref, "key")


@query("dqc_row_counts", """
SELECT 'orders' AS check, a AS n_before, b AS n_after, a = b AS preserved, b > 0 AS non_empty FROM (SELECT count(*) AS a FROM orders), (SELECT count(*) AS b FROM orders JOIN customer ON o_custkey = c_custkey)
UNION ALL SELECT 'filtered', a, b, a = b, b > 0 FROM (SELECT count(*) AS a FROM lineitem), (SELECT count(*) AS b FROM lineitem WHERE l_quantity > 25)""")
def dqc_row_counts(spark, sf):
    o, c, line = tab(spark, sf, "orders"), tab(spark, sf, "customer"), tab(spark, sf, "lineitem")
    return quality.row_counts({
        "orders": (o, o.join(c, o.o_custkey == c.c_custkey)), "filtered": (line, line.where("l_quantity > 25")),
    })


@query("dqc_rank_contiguity", """
SELECT 'ranked' AS name, CAST(1 AS BIGINT) AS min_rank, count(*) AS max_rank, count(*) AS n_rows, count(*) AS n_ranks, true AS contiguous FROM orders
UNION ALL SELECT 'keys', CAST(min(l_orderkey) AS BIGINT), CAST(max(l_orderkey) AS BIGINT), count(*), count(DISTINCT l_orderkey),
       min(l_orderkey) = 1 AND max(l_orderkey) = count(*) AND count(DISTINCT l_orderkey) = count(*) FROM lineitem""")
def dqc_rank_contiguity(spark, sf):
    """A ranking without gaps, and a column that is none."""
    ranked = global_rank(tab(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")])
    keys = tab(spark, sf, "lineitem").select(F.col("l_orderkey").cast("bigint").alias("rank"))
    parts = [quality.rank_gaps(df, "rank").withColumns({c: F.col(c).cast("bigint") for c in ("min_rank", "max_rank")}).withColumn("name", F.lit(n)) for n, df in (("ranked", ranked), ("keys", keys))]
    return parts[0].unionByName(parts[1])


@query("dqc_rules", with_views("x_targets", "x_diff", body="""
SELECT 'flag equals rule' AS check, count(*) FILTER (NOT (is_deg = coalesce(abs(effect) >= 1 AND p_value < 0.05, false))) AS n_bad FROM x_diff
UNION ALL SELECT 'p below one half', count(*) FILTER (NOT coalesce(p_value < 0.5, false)) FROM x_diff
UNION ALL SELECT 'not found has no score', count(*) FILTER (geo_support_level = 'Not Found' AND final_score IS NOT NULL) FROM x_targets"""))
def dqc_rules(spark, sf):
    called = F.coalesce((F.abs("effect") >= 1) & (F.col("p_value") < 0.05), F.lit(False))
    a = quality.violations(x_diff(spark, sf), {"flag equals rule": F.col("is_different") == called, "p below one half": F.col("p_value") < 0.5})
    b = quality.violations(x_targets(spark, sf), {
        "not found has no score": (F.col("geo_support_level") != "Not Found") | F.col("final_score").isNull(),
    })
    return a.unionByName(b)


@query("dqc_totals", """
SELECT 'same' AS name, count(*) AS n_summary, round(100.0e0, 6) AS percent_total, count(*) AS n_expected, true AS counts_agree, true AS percent_agrees FROM orders
UNION ALL SELECT 'other', a, round(50.0e0, 6), b, a = b, false FROM (SELECT count(*) AS a FROM orders), (SELECT count(*) AS b FROM lineitem)""")
def dqc_totals(spark, sf):
    """Shares of the table itself, and halved shares against another table."""
    o = tab(spark, sf, "orders")
    own = shares(o, "o_orderpriority")
    halved = own.withColumn("percentage", F.col("percentage") / 2)
    a, b = quality.reconcile_totals(own, "n", "percentage", o), quality.reconcile_totals(halved, "n", "percentage", tab(spark, sf, "lineitem"))
    return a.withColumn("name", F.lit("same")).unionByName(b.withColumn("name", F.lit("other"))).withColumn("percent_total", r6("percent_total"))


@query("dqc_leaks", with_views("x_qc", body="SELECT count(*) AS n_leaked FROM lineitem WHERE l_suppkey + 1 IN (SELECT sample_id FROM x_qc WHERE n_detected <= 200)"))
def dqc_leaks(spark, sf):
    out = tab(spark, sf, "lineitem").select((F.col("l_suppkey") + 1).alias("sample_id"))
    return quality.leaks(out, x_qc(spark, sf).where("n_detected <= 200"), ["sample_id"])


@query("dqc_readback", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def dqc_readback(spark, sf):
    path = working_path(spark, "readback")
    rows = tab(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    write_table(rows, path)
    return quality.verify_written(spark, path, rows.schema)
