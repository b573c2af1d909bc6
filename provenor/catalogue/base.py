"""Registry of checked queries and the derived tables they share.

Each derived table exists twice: as a DataFrame built with the library and as
SQL text for the side-by-side check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenor.functions import log2p1
from provenor.operators.stats import call_diff, two_group_test
from provenor.plans.mapping import entity_map
from provenor.session import tasks_for

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the SQL that must give the same rows."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def tab(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded double for comparison; adding zero turns -0.0 into 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def money(c: Column | str) -> Column:
    """Exact sum of two-decimal amounts."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")).cast("double")


# --- derived tables ---------------------------------------------------------

SQL_VIEWS: dict[str, str] = {
    "x_expr": """
SELECT l_suppkey AS sample_id, l_orderkey AS case_id, l_linenumber AS line_no, replace(p_name, ' ', '-') || '-' || p_brand AS gene,
       l_partkey AS part_id, p_type AS gene_type,
       CASE l_returnflag WHEN 'R' THEN 'case' WHEN 'A' THEN 'control' ELSE 'other' END AS grp,
       l_extendedprice * factor AS value, log2(l_extendedprice * factor + 1) AS log_value, CAST(l_quantity AS BIGINT) AS n
FROM (SELECT *, CASE WHEN l_returnflag = 'R' AND p_size % 3 = 0 OR l_returnflag = 'A' AND p_size % 3 = 1 THEN 8e0 ELSE 1e0 END AS factor
      FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "x_edges": """
SELECT 'P' || l_partkey AS src, 'S' || l_suppkey AS dst, max(l_quantity) * 20 AS score, max(l_quantity) * 20 / 1000.0e0 AS weight
FROM lineitem GROUP BY l_partkey, l_suppkey""",
    "x_alias": """
SELECT 'P' || p_partkey AS protein_id, replace(p_name, ' ', '-') || '-' || p_brand AS alias_value, 'symbol' AS source FROM part WHERE p_size % 10 <> 0
UNION ALL SELECT 'P' || p_partkey, p_brand, 'brand' FROM part WHERE p_size % 7 <> 0
UNION ALL SELECT 'P' || p_partkey, p_type, 'brand' FROM part WHERE p_size % 5 = 0
UNION ALL SELECT 'P' || p_partkey, p_type, 'kind' FROM part""",
    "x_map": """
SELECT protein_id, brand, symbol, upper(regexp_replace(trim(symbol), '\\s+', '', 'g')) AS symbol_norm,
       CASE WHEN brand IS NOT NULL AND symbol IS NOT NULL THEN 'high'
            WHEN brand IS NOT NULL OR symbol IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence
FROM (SELECT protein_id, min(CASE WHEN source = 'brand' AND regexp_matches(alias_value, '^Brand') THEN alias_value END) AS brand,
             min(CASE WHEN source = 'symbol' THEN alias_value END) AS symbol
      FROM x_alias WHERE source IN ('brand', 'symbol') GROUP BY protein_id)""",
    "x_qc": """
SELECT sample_id, sample_id % 3 AS grp, sum(n) AS total_count, count(*) FILTER (value > 50000) AS n_detected
FROM x_expr GROUP BY sample_id""",
    "x_targets": """
SELECT c_custkey + 1 AS rank, c_name AS gene_name, 'C' || c_custkey AS protein_id, 'E' || (c_custkey * 7) AS ensp_id,
       c_nationkey AS cluster_id, c_mktsegment AS candidate_group,
       CASE WHEN c_acctbal > 7000 THEN 'Strong GEO support' WHEN c_acctbal > 3000 THEN 'Moderate GEO support'
            WHEN c_acctbal > 0 THEN 'Limited GEO support' ELSE 'Not Found' END AS geo_support_level,
       CASE WHEN c_custkey % 2 = 0 THEN 'Upregulated' ELSE 'Downregulated' END AS deg_direction,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE (c_acctbal + 1000) / 11000 END AS final_score
FROM customer""",
    "x_moments": """
SELECT gene, grp, avg(value) AS mean_value, avg(log_value) AS mean_log, var_samp(log_value) AS var_log,
       count(log_value) AS n_values, count(DISTINCT sample_id) AS n_samples
FROM x_expr GROUP BY gene, grp""",
    "x_cluster": """
SELECT vec_id, CAST(label AS INTEGER) AS cluster_id, abs(CAST(embedding[1] AS DOUBLE)) AS f1, abs(CAST(embedding[2] AS DOUBLE)) * 100 AS f2,
       CAST(embedding[3] AS DOUBLE) AS f3, CAST(embedding[4] AS DOUBLE) AS score
FROM embeddings""",
}
_ORDER = list(SQL_VIEWS)


def sql_erfc(x: str) -> str:
    """SQL text of erfc for x >= 0 by other means than the library's: the power series below 2, the continued fraction above."""
    series = "0e0"
    for n in range(40, 0, -1):  # erf(x) = 2/sqrt(pi) exp(-x^2) x (1 + 2x^2/3 (1 + 2x^2/5 (1 + ...)))
        series = f"(2e0*({x})*({x})/{2 * n + 1}e0*(1e0+{series}))"
    fraction = f"({x})"
    for n in range(60, 0, -1):  # erfc(x) = exp(-x^2)/sqrt(pi) / (x + (1/2)/(x + 1/(x + (3/2)/(x + ...))))
        fraction = f"(({x})+{n / 2}e0/{fraction})"
    return f"CASE WHEN {x} < 2e0 THEN 1e0-2e0/sqrt(pi())*exp(-({x})*({x}))*({x})*(1e0+{series}) ELSE exp(-({x})*({x}))/sqrt(pi())/{fraction} END"


SQL_VIEWS["x_diff"] = f"""
SELECT *, abs(effect) >= 1 AND coalesce(p_value < 0.05, false) AS is_deg,
       CASE WHEN effect > 0 THEN 'Upregulated' WHEN effect < 0 THEN 'Downregulated' ELSE 'No change' END AS direction
FROM (SELECT *, CASE WHEN z > 27.3 THEN 0e0 WHEN z IS NOT NULL THEN {sql_erfc('z')} END AS p_value
FROM (SELECT *, abs(t_stat) / 1.4142135623730951e0 AS z
FROM (SELECT *, CASE WHEN least(n_case, n_control) >= 2 AND se > 0 THEN effect / se END AS t_stat
FROM (SELECT *, mean_log_case - mean_log_control AS effect, sqrt(var_case / n_case + var_control / n_control) AS se
FROM (SELECT gene, max(CASE WHEN grp = 'case' THEN mean_value END) AS mean_case, max(CASE WHEN grp = 'control' THEN mean_value END) AS mean_control,
             max(CASE WHEN grp = 'case' THEN mean_log END) AS mean_log_case, max(CASE WHEN grp = 'control' THEN mean_log END) AS mean_log_control,
             max(CASE WHEN grp = 'case' THEN var_log END) AS var_case, max(CASE WHEN grp = 'control' THEN var_log END) AS var_control,
             max(CASE WHEN grp = 'case' THEN n_values END) AS n_case, max(CASE WHEN grp = 'control' THEN n_values END) AS n_control
      FROM x_moments GROUP BY gene) WHERE mean_log_case IS NOT NULL AND mean_log_control IS NOT NULL))))"""
_ORDER.append("x_diff")


def with_views(*names: str, body: str, **more: str) -> str:
    """SQL with the named derived tables, and those they build on, in front."""
    need = set(names)
    if "x_map" in need:
        need.add("x_alias")
    if "x_diff" in need:
        need.add("x_moments")
    if need & {"x_qc", "x_moments"}:
        need.add("x_expr")
    ctes = [f"{n} AS ({SQL_VIEWS[n]})" for n in _ORDER if n in need] + [f"{n} AS ({s})" for n, s in more.items()]
    body = body.strip()
    return f"WITH {', '.join(ctes)}{'' if body.startswith(',') else ' '}{body}"


def x_expr(spark: SparkSession, sf: str) -> DataFrame:
    """Long fact table: one row per (sample, entity, line) with a group label; two thirds of the entities have a planted effect."""
    line = tab(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice", "l_quantity")
    part = tab(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type", "p_size")
    grp = F.when(F.col("l_returnflag") == "R", "case").when(F.col("l_returnflag") == "A", "control").otherwise("other")
    raised = ((F.col("l_returnflag") == "R") & (F.col("p_size") % 3 == 0)) | ((F.col("l_returnflag") == "A") & (F.col("p_size") % 3 == 1))
    value = F.col("l_extendedprice") * F.when(raised, 8.0).otherwise(1.0)
    return line.join(part, "l_partkey").select(
        F.col("l_suppkey").alias("sample_id"), F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("line_no"),
        F.concat_ws("-", F.replace("p_name", F.lit(" "), F.lit("-")), "p_brand").alias("gene"), F.col("l_partkey").alias("part_id"), F.col("p_type").alias("gene_type"),
        grp.alias("grp"), value.alias("value"), log2p1(value).alias("log_value"),
        big("l_quantity").alias("n"),
    )


def edge_tasks(spark: SparkSession, sf: str, times: int = 1) -> int:
    """Tasks for ``times`` as many rows as the edges are made from."""
    return tasks_for(spark, times * tab(spark, sf, "lineitem").count())


def x_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Interaction edges between parts and suppliers."""
    line = tab(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_quantity").repartition(edge_tasks(spark, sf), "l_partkey", "l_suppkey")
    pairs = line.groupBy("l_partkey", "l_suppkey").agg((F.max("l_quantity") * 20).alias("score"))
    return pairs.select(
        F.concat(F.lit("P"), "l_partkey").alias("src"), F.concat(F.lit("S"), "l_suppkey").alias("dst"),
        "score", (F.col("score") / 1000.0).alias("weight"),
    )


def x_alias(spark: SparkSession, sf: str) -> DataFrame:
    part = tab(spark, sf, "part").select(F.concat(F.lit("P"), "p_partkey").alias("protein_id"), "p_name", "p_brand", "p_type", "p_size")
    def row(alias: Column, source: str, ok: Column) -> Column:
        return F.struct(alias.alias("alias_value"), F.lit(source).alias("source"), ok.alias("ok"))

    size = F.col("p_size")
    name = F.concat_ws("-", F.replace("p_name", F.lit(" "), F.lit("-")), "p_brand")
    return part.select("protein_id", F.inline(F.array(
        row(name, "symbol", size % 10 != 0), row(F.col("p_brand"), "brand", size % 7 != 0),
        row(F.col("p_type"), "brand", size % 5 == 0), row(F.col("p_type"), "kind", F.lit(True)),
    ))).where("ok").drop("ok")


def x_map(spark: SparkSession, sf: str) -> DataFrame:
    return entity_map(
        x_alias(spark, sf), "protein_id", "alias_value", "source",
        id_source="brand", name_source="symbol", id_pattern="^Brand", id_out="brand", name_out="symbol",
        norm_out="symbol_norm", confidence_out="confidence",
    )


def x_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Two-group test per entity with its call."""
    return call_diff(two_group_test(x_expr(spark, sf), ["gene"], "grp", "value", "log_value", "case", "control"))


def x_qc(spark: SparkSession, sf: str) -> DataFrame:
    return x_expr(spark, sf).groupBy("sample_id").agg(
        F.sum("n").alias("total_count"), F.count_if(F.col("value") > 50000).alias("n_detected")
    ).select("sample_id", (F.col("sample_id") % 3).alias("grp"), "total_count", "n_detected")


def x_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked candidates in the shape of the final ranking table."""
    bal = F.col("c_acctbal")
    return tab(spark, sf, "customer").select(
        (F.col("c_custkey") + 1).alias("rank"), F.col("c_name").alias("gene_name"),
        F.concat(F.lit("C"), "c_custkey").alias("protein_id"), F.concat(F.lit("E"), F.col("c_custkey") * 7).alias("ensp_id"),
        F.col("c_nationkey").alias("cluster_id"), F.col("c_mktsegment").alias("candidate_group"),
        F.when(bal > 7000, "Strong GEO support").when(bal > 3000, "Moderate GEO support").when(bal > 0, "Limited GEO support")
        .otherwise("Not Found").alias("geo_support_level"),
        F.when(F.col("c_custkey") % 2 == 0, "Upregulated").otherwise("Downregulated").alias("deg_direction"),
        F.when(F.col("c_custkey") % 11 == 0, None).otherwise((bal + 1000) / 11000).alias("final_score"),
    )


def x_cluster(spark: SparkSession, sf: str) -> DataFrame:
    def at(i: int) -> Column:
        return F.col("embedding")[i].cast("double")

    return tab(spark, sf, "embeddings").select(
        "vec_id", F.col("label").cast("int").alias("cluster_id"), F.abs(at(0)).alias("f1"), (F.abs(at(1)) * 100).alias("f2"),
        at(2).alias("f3"), at(3).alias("score"),
    )


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as numbered lines."""
    return tab(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


SQL_LINES = """
SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents"""
