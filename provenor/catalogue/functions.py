"""Checked queries for the scalar function families."""

from pyspark.sql import functions as F

from provenor.catalogue.base import big, query, r6, sql_erfc, tab
from provenor.functions import finite_or_null, log2p1, neg_log10, not_blank, ratio, two_sided_p
from provenor.operators.ordering import number_rows, with_previous


@query("fn_string", """
SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, trim('  ' || p_name || ' ') AS trimmed, rtrim(p_name || chr(13), chr(13)) AS no_cr, concat_ws('|', p_name, p_brand, p_type) AS joined,
       split_part(p_name, ' ', 2) AS second_word, len(string_split(p_name, ' ')) AS n_words, regexp_extract(p_brand, '#([0-9]+)', 1) AS brand_no, regexp_replace(p_brand, '[0-9]+$', 'N') AS masked, length(p_name) AS n_chars,
       'title: ' || p_name || ' | text: ' || p_type AS titled FROM part""")
def fn_string(spark, sf):
    words = F.split("p_name", r"\s+")
    return tab(spark, sf, "part").select(
        "p_partkey", F.upper("p_name").alias("up"), F.lower("p_brand").alias("low"), F.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("trimmed"),
        F.rtrim(F.concat("p_name", F.lit("\r")), F.lit("\r")).alias("no_cr"), F.concat_ws("|", "p_name", "p_brand", "p_type").alias("joined"),
        F.coalesce(F.try_element_at(words, F.lit(2)), F.lit("")).alias("second_word"), big(F.size(words)).alias("n_words"),
        F.regexp_extract("p_brand", "#([0-9]+)", 1).alias("brand_no"), F.regexp_replace("p_brand", "[0-9]+$", "N").alias("masked"),
        big(F.length("p_name")).alias("n_chars"), F.format_string("title: %s | text: %s", "p_name", "p_type").alias("titled"),
    )


@query("fn_predicate", """
SELECT regexp_matches(p_name, '^(red|blue)') AS colour, starts_with(p_name, 'new') AS is_new, ends_with(p_brand, '7') AS seven, contains(p_name, 'wid') AS wid, p_type IN ('SMALL', 'LARGE') AS sized,
       p_size BETWEEN 10 AND 20 AS mid, NOT p_size > 30 AS small, length(trim(p_name)) > 0 AS present,
       regexp_matches(upper(p_name), '(^|[^A-Z0-9_.-])BOLT($|[^A-Z0-9_.-])') AS token, count(*) AS n FROM part GROUP BY ALL""")
def fn_predicate(spark, sf):
    cols = {
        "colour": F.rlike("p_name", F.lit("^(red|blue)")), "is_new": F.startswith("p_name", F.lit("new")), "seven": F.endswith("p_brand", F.lit("7")),
        "wid": F.contains("p_name", F.lit("wid")), "sized": F.col("p_type").isin("SMALL", "LARGE"), "mid": F.col("p_size").between(10, 20),
        "small": ~(F.col("p_size") > 30), "present": not_blank("p_name"), "token": F.rlike(F.upper("p_name"), F.lit(r"(?<![A-Z0-9_.-])BOLT(?![A-Z0-9_.-])")),
    }
    return tab(spark, sf, "part").select(*[c.alias(n) for n, c in cols.items()]).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


@query("fn_conversion", """
SELECT o_orderkey, CAST(o_totalprice AS BIGINT) IS NOT NULL AS has_price, try_cast(substr(o_orderpriority, 1, 1) AS BIGINT) AS level, try_cast(o_orderpriority AS DOUBLE) AS bad,
       CAST(o_orderstatus = 'F' AS INTEGER) AS is_f, CAST(o_custkey AS BIGINT) AS cust FROM orders""")
def fn_conversion(spark, sf):
    return tab(spark, sf, "orders").select(
        "o_orderkey", F.col("o_totalprice").cast("bigint").isNotNull().alias("has_price"), F.substring("o_orderpriority", 1, 1).try_cast("bigint").alias("level"),
        F.col("o_orderpriority").try_cast("double").alias("bad"), (F.col("o_orderstatus") == "F").cast("int").alias("is_f"), big("o_custkey").alias("cust"),
    )


@query("fn_math", """
SELECT p_partkey, abs(p_size - 25) AS gap, round(sqrt(p_retailprice), 6) AS root, round(log2(p_retailprice + 1), 6) AS l2, round(ln(1 + p_retailprice), 6) AS l1p, round(log10(p_retailprice), 6) AS l10,
       least(p_size, 20) AS low, greatest(p_size, 20) AS high, round(p_retailprice / nullif(p_size % 4, 0), 6) AS part_ratio, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_retailprice END AS finite, round(p_retailprice / 7, 4) AS r4, round(p_retailprice / 7, 2) AS r2 FROM part""")
def fn_math(spark, sf):
    v, s = F.col("p_retailprice"), F.col("p_size")
    odd = F.when(s % 6 == 0, float("nan")).when(s % 3 == 0, float("inf")).otherwise(v)
    return tab(spark, sf, "part").select(
        "p_partkey", F.abs(s - 25).alias("gap"), r6(F.sqrt(v)).alias("root"), r6(log2p1(v)).alias("l2"), r6(F.log1p(v)).alias("l1p"), r6(F.log10(v)).alias("l10"),
        F.least(s, F.lit(20)).alias("low"), F.greatest(s, F.lit(20)).alias("high"), r6(ratio(v, s % 4)).alias("part_ratio"), finite_or_null(odd).alias("finite"),
        r6(v / 7, 4).alias("r4"), r6(v / 7, 2).alias("r2"),
    )


@query("fn_aggregate", """
SELECT l_returnflag, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total, round(avg(l_discount), 6) AS mean, round(var_samp(l_tax), 9) AS var, min(l_quantity) AS lo, max(l_quantity) AS hi, count(DISTINCT l_suppkey) AS n_supp,
       count(DISTINCT CASE WHEN l_quantity > 45 THEN l_partkey END) AS n_big, bool_or(l_tax > 0.07) AS any_tax, quantile_cont(l_linenumber, 0.5) AS median FROM lineitem GROUP BY 1""")
def fn_aggregate(spark, sf):
    return tab(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), big(F.sum("l_linenumber")).alias("total"), r6(F.avg("l_discount")).alias("mean"), r6(F.var_samp("l_tax"), 9).alias("var"),
        F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), F.count_distinct("l_suppkey").alias("n_supp"),
        F.count_distinct(F.when(F.col("l_quantity") > 45, F.col("l_partkey"))).alias("n_big"), F.bool_or(F.col("l_tax") > 0.07).alias("any_tax"),
        F.percentile_approx("l_linenumber", 0.5, 10000).cast("double").alias("median"),
    )


@query("fn_array_nested", """
SELECT o_orderkey, v.k AS k, v.x AS x, 'c,b' AS items FROM (SELECT o_orderkey, unnest([{'k': 'status', 'x': o_orderstatus}, {'k': 'priority', 'x': o_orderpriority}]) AS v FROM orders WHERE o_orderkey % 2 = 0)
UNION ALL SELECT o_orderkey, NULL, NULL, 'c,b' FROM orders WHERE o_orderkey % 2 = 1""")
def fn_array_nested(spark, sf):
    pair = F.array(
        F.struct(F.lit("status").alias("k"), F.col("o_orderstatus").alias("x")), F.struct(F.lit("priority").alias("k"), F.col("o_orderpriority").alias("x"))
    )
    rows = tab(spark, sf, "orders").select("o_orderkey", F.explode_outer(F.when(F.col("o_orderkey") % 2 == 0, pair)).alias("v"))
    listed = F.array_join(F.sort_array(F.array(F.lit("b"), F.lit("c")), asc=False), ",")
    return rows.select("o_orderkey", F.col("v.k").alias("k"), F.col("v.x").alias("x"), listed.alias("items"))


@query("fn_conditional", """
SELECT c_custkey, coalesce(CASE WHEN c_acctbal < 0 THEN 'debt' END, CASE WHEN c_acctbal > 5000 THEN 'rich' END, 'plain') AS kind, CASE WHEN c_nationkey < 5 THEN 1 WHEN c_nationkey < 15 THEN 2 ELSE 3 END AS band,
       nullif(c_mktsegment, 'BUILDING') IS NULL AS is_building, CAST(NULL AS VARCHAR) AS nothing FROM customer""")
def fn_conditional(spark, sf):
    bal, nat = F.col("c_acctbal"), F.col("c_nationkey")
    return tab(spark, sf, "customer").select(
        "c_custkey", F.coalesce(F.when(bal < 0, "debt"), F.when(bal > 5000, "rich"), F.lit("plain")).alias("kind"),
        F.when(nat < 5, 1).when(nat < 15, 2).otherwise(3).alias("band"), F.nullif("c_mktsegment", F.lit("BUILDING")).isNull().alias("is_building"),
        F.lit(None).cast("string").alias("nothing"),
    )


@query("fn_ordering", """
SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_acctbal > 0 THEN c_acctbal END DESC NULLS LAST, c_custkey) AS BIGINT) AS down,
       CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_acctbal > 0 THEN c_acctbal END ASC NULLS LAST, c_custkey) AS BIGINT) AS up FROM customer""")
def fn_ordering(spark, sf):
    """Null placement in both directions, numbered without one task per key."""
    rows = tab(spark, sf, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("bal"))
    down = number_rows(rows, [F.col("bal").desc_nulls_last(), F.col("c_custkey").asc()], ["c_nationkey"], "down")
    both = number_rows(down, [F.col("bal").asc_nulls_last(), F.col("c_custkey").asc()], ["c_nationkey"], "up")
    return both.select("c_custkey", "down", "up")


@query("fn_window", """
SELECT user_id, event_id, CAST(row_number() OVER w AS BIGINT) AS rn, round(percent_rank() OVER w, 6) AS pr, lag(event_id) OVER w AS prev, count(*) OVER (PARTITION BY user_id) AS n
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id)""")
def fn_window(spark, sf):
    """Row number, relative rank, previous row and group size per user, however many events one user has."""
    rows = tab(spark, sf, "events").select("user_id", "event_id", "value")
    order = [F.col("value").asc(), F.col("event_id").asc()]
    placed = number_rows(with_previous(rows, order, ["event_id"], keys=["user_id"]), order, ["user_id"], "rn", "n")
    pr = F.when(F.col("n") <= 1, F.lit(0.0)).otherwise((F.col("rn") - 1) / F.nullif(F.col("n") - 1, F.lit(0)))
    return placed.select("user_id", "event_id", "rn", r6(pr).alias("pr"), F.col("prev_event_id").alias("prev"), "n")


@query("fn_json", """
SELECT event_id, '{"type":"' || event_type || '","user":' || user_id || '}' AS doc, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def fn_json(spark, sf):
    return tab(spark, sf, "events").select(
        "event_id", F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"))).alias("doc"),
        F.from_json("props", "k bigint")["k"].alias("k"),
    )


@query("fn_date", """
SELECT 'run_date=' || strftime(o_orderdate, '%Y-%m-%d') AS part, strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%SZ') AS stamp, count(*) AS n FROM orders GROUP BY 1""")
def fn_date(spark, sf):
    day = F.concat(F.lit("run_date="), F.date_format("o_orderdate", "yyyy-MM-dd"))
    return tab(spark, sf, "orders").groupBy(day.alias("part")).agg(
        F.date_format(F.max("o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"), F.count(F.lit(1)).alias("n")
    )


@query("fn_p_values", f"""
SELECT o_orderkey, round(-log10(p), 6) AS height FROM (SELECT o_orderkey, {sql_erfc('z')} AS p FROM (SELECT o_orderkey, (o_orderkey % 3700) / 100.0e0 / 1.4142135623730951e0 AS z FROM orders))""")
def fn_p_values(spark, sf):
    """Two-sided p-values from 1 to about 1e-299."""
    t = (F.col("o_orderkey") % 3700) / F.lit(100.0)
    return tab(spark, sf, "orders").select("o_orderkey", r6(neg_log10(two_sided_p(t), cap=400.0)).alias("height"))
