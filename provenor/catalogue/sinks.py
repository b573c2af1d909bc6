"""Checked queries for sinks; written data goes to the shared working folder and is read back."""

from pyspark.sql import functions as F

from provenor.catalogue.base import big, money, query, tab
from provenor.session import working_path
from provenor.sinks import tables as sinks
from provenor.sources.tables import read_snapshot, read_table


@query("snk_parquet_roundtrip", """
SELECT l_returnflag, l_suppkey, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM lineitem GROUP BY l_returnflag, l_suppkey""")
def snk_parquet_roundtrip(spark, sf):
    path = working_path(spark, "roundtrip")
    rows = tab(spark, sf, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), money("l_extendedprice").alias("total"))
    sinks.write_sized(rows, path, partition_by=["l_returnflag"])
    return read_table(spark, path)


@query("snk_scrub_nonfinite", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 OR c_acctbal > 9000 OR c_custkey % 10 = 3 THEN NULL ELSE c_acctbal END AS balance,
       CASE WHEN c_acctbal < 0 OR c_acctbal > 9000 OR c_custkey % 10 = 3 THEN NULL ELSE c_acctbal END AS inner_balance FROM customer""")
def snk_scrub_nonfinite(spark, sf):
    odd = (
        F.when(F.col("c_acctbal") < 0, float("nan")).when(F.col("c_custkey") % 10 == 3, float("-inf"))
        .when(F.col("c_acctbal") > 9000, float("inf")).otherwise(F.col("c_acctbal"))
    )
    rows = tab(spark, sf, "customer").select("c_custkey", odd.alias("balance"), F.struct(odd.alias("v")).alias("nested"))
    return sinks.scrub_nonfinite(rows).select("c_custkey", "balance", F.col("nested.v").alias("inner_balance"))


@query("snk_csv_guard", """
SELECT chr(65279) || '"c_custkey","note","balance"' AS value
UNION ALL SELECT '"' || c_custkey || '","' || CASE c_custkey % 4 WHEN 0 THEN '''=1+' || c_custkey WHEN 1 THEN 'x""' || c_custkey WHEN 2 THEN '''@' || c_name ELSE '' END
       || '","' || CASE WHEN c_acctbal < 0 THEN '''' ELSE '' END || CAST(c_acctbal AS VARCHAR) || '"' FROM customer""")
def snk_csv_guard(spark, sf):
    kind = F.col("c_custkey") % 4
    note = (
        F.when(kind == 0, F.concat(F.lit("=1+"), "c_custkey")).when(kind == 1, F.concat(F.lit('x"'), "c_custkey"))
        .when(kind == 2, F.concat(F.lit("@"), "c_name"))
    )
    rows = tab(spark, sf, "customer").select("c_custkey", note.alias("note"), F.col("c_acctbal").alias("balance"))
    return sinks.csv_lines(rows, [F.col("c_custkey")])


@query("snk_metrics_long", """
SELECT 'rows' AS metric_name, CAST(count(*) AS VARCHAR) AS metric_value, 'all orders' AS details FROM orders
UNION ALL SELECT 'customers', CAST(count(DISTINCT o_custkey) AS VARCHAR), 'distinct customers' FROM orders
UNION ALL SELECT 'max_key', CAST(max(o_orderkey) AS VARCHAR), 'largest key' FROM orders""")
def snk_metrics_long(spark, sf):
    """Row count and largest key come from the write itself, the distinct count from one column of what was written."""
    path = working_path(spark, "orders")
    seen = sinks.write_observed(tab(spark, sf, "orders"), path, {"rows": (F.count(F.lit(1)), "all orders"), "max_key": (F.max("o_orderkey"), "largest key")})
    distinct = sinks.metrics_table(read_table(spark, path), {"customers": (F.count_distinct("o_custkey"), "distinct customers")})
    return seen.unionByName(distinct).drop("created_at")


@query("snk_vector_hydrate", """
WITH live AS (SELECT vec_id, 'live' AS origin, label FROM embeddings WHERE label < 4),
snap AS (SELECT vec_id, 'snapshot' AS origin, label FROM embeddings WHERE label >= 3),
c AS (SELECT (SELECT count(*) FROM live) < (SELECT count(*) FROM snap) AS short)
SELECT vec_id, origin, CAST(label AS BIGINT) AS label FROM live, c WHERE NOT (short AND vec_id IN (SELECT vec_id FROM snap))
UNION ALL SELECT vec_id, origin, CAST(label AS BIGINT) FROM snap, c WHERE short""")
def snk_vector_hydrate(spark, sf):
    vec = tab(spark, sf, "embeddings").withColumn("meta", F.create_map(F.lit("label"), F.col("label").cast("string")))
    path = working_path(spark, "vectors")
    sinks.export_vectors(vec.where("label >= 3").withColumn("text", F.lit("snapshot")), path, "vec_id", "text", "meta", "embedding")
    live = vec.where("label < 4").select(
        F.col("vec_id").alias("id"), F.lit("live").alias("document"), F.col("meta").alias("metadata"), "embedding"
    )
    return sinks.hydrate(live, read_table(spark, path), "id").select(
        F.col("id").alias("vec_id"), F.col("document").alias("origin"), big(F.col("metadata")["label"]).alias("label")
    )


@query("snk_sync", """
SELECT 'suppliers' AS name, count(*) AS n_rows, CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total FROM supplier
UNION ALL SELECT 'customers', count(*), CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) FROM customer""")
def snk_sync(spark, sf):
    source, target = working_path(spark, "snapshots"), working_path(spark, "synced")
    names = {"suppliers": ("supplier", "s_acctbal"), "customers": ("customer", "c_acctbal")}
    for name, (t, col) in names.items():
        sinks.write_snapshot(tab(spark, sf, t).select(F.col(col).alias("balance")), f"{source}/{name}")
    sinks.sync_snapshots(spark, source, [*names, "absent"], target)
    parts = [
        read_snapshot(spark, target, n, "balance double").agg(F.count(F.lit(1)).alias("n_rows"), money("balance").alias("total"))
        .select(F.lit(n).alias("name"), "n_rows", "total")
        for n in names
    ]
    return parts[0].unionByName(parts[1])
