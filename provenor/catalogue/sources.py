"""Checked queries for readers and parsers."""

from pyspark.sql import functions as F

from provenor.catalogue.base import SQL_LINES, big, doc_lines, money, query, tab
from provenor.session import working_path
from provenor.sources import files, landing, tables


@query("src_nested_json", """
WITH o AS (SELECT 'F' || o_orderkey AS file_id, 'orders-' || o_orderkey || '.tsv' AS file_name, 'C' || o_custkey AS case_id,
                  'S' || o_orderkey AS sid, o_orderstatus AS st,
                  CASE o_orderpriority WHEN '1-URGENT' THEN 'Primary Tumor' WHEN '2-HIGH' THEN 'Solid Tissue Normal'
                       WHEN '3-MEDIUM' THEN 'Primary normal' WHEN '4-NOT SPECIFIED' THEN NULL ELSE 'Blood' END AS ty,
                  o_orderkey % 9 = 0 AS no_case
           FROM orders),
s AS (SELECT file_id, file_name, case_id, sid || 'a' AS sample_id, ty AS sample_type, st AS tissue_type FROM o WHERE NOT no_case
      UNION ALL SELECT file_id, file_name, case_id, sid || 'b', 'Recurrent', NULL FROM o WHERE NOT no_case
      UNION ALL SELECT file_id, file_name, NULL, NULL, NULL, NULL FROM o WHERE no_case)
SELECT *, CASE WHEN regexp_matches(lower(concat_ws(' ', sample_type, tissue_type)), 'normal') THEN 'normal'
               WHEN regexp_matches(lower(concat_ws(' ', sample_type, tissue_type)), 'tumou?r|recurrent|metastatic|primary') THEN 'tumor'
               ELSE 'other' END AS sample_group FROM s""")
def src_nested_json(spark, sf):
    kind = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "Primary Tumor").when(F.col("o_orderpriority") == "2-HIGH", "Solid Tissue Normal")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "Primary normal").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", None).otherwise("Blood")
    )
    sid = F.concat(F.lit("S"), F.col("o_orderkey"))

    def sample(suffix, t, tissue):
        return F.struct(F.concat(sid, F.lit(suffix)).alias("sample_id"), t.alias("sample_type"), tissue.alias("tissue_type"))

    case = F.struct(
        F.concat(F.lit("C"), F.col("o_custkey")).alias("case_id"),
        F.array(sample("a", kind, F.col("o_orderstatus")), sample("b", F.lit("Recurrent"), F.lit(None).cast("string"))).alias("samples"),
    )
    hit = F.struct(
        F.concat(F.lit("F"), F.col("o_orderkey")).alias("file_id"),
        F.concat(F.lit("orders-"), F.col("o_orderkey"), F.lit(".tsv")).alias("file_name"),
        F.when(F.col("o_orderkey") % 9 != 0, F.array(case)).alias("cases"),
    )
    raw = tab(spark, sf, "orders").select(F.to_json(F.struct(F.struct(F.array(hit).alias("hits")).alias("data"))).alias("doc"))
    return files.flatten_index(raw.select(F.from_json("doc", files.INDEX_SCHEMA).alias("d")).select("d.*"))


@query("src_file_lineage", """
SELECT 'lineitem' AS file_id, 'lineitem.parquet' AS file_name, count(*) AS n_rows, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem""")
def src_file_lineage(spark, sf):
    rows = files.with_lineage(tab(spark, sf, "lineitem").select("l_linenumber", "_metadata"), r"([^/]+)\.parquet")
    return rows.groupBy("file_id", "file_name").agg(F.count(F.lit(1)).alias("n_rows"), big(F.sum("l_linenumber")).alias("total"))


@query("src_file_inventory", """
SELECT 'orders' AS file_id, 'orders.parquet' AS count_file_name FROM orders GROUP BY 1, 2
UNION ALL SELECT 'lineitem', 'lineitem.parquet' FROM lineitem GROUP BY 1, 2
UNION ALL SELECT 'events', 'events.parquet' FROM events GROUP BY 1, 2""")
def src_file_inventory(spark, sf):
    return files.file_inventory(spark, [f"{sf}/{t}.parquet" for t in ("orders", "lineitem", "events")], r"([^/]+)\.parquet").select("file_id", "count_file_name")


_LINK_LINE = """
CASE WHEN l_linenumber = 1 AND l_returnflag = 'N' THEN '# comment ' || l_orderkey || ' 5'
     WHEN l_linenumber = 2 AND l_returnflag = 'A' THEN 'protein1 protein2 combined_score'
     WHEN l_linenumber = 3 AND l_returnflag = 'R' THEN '9606.P' || l_partkey || ' short'
     WHEN l_linenumber = 4 AND l_returnflag = 'A' THEN '9606.P' || l_partkey || ' 9606.S' || l_suppkey || ' n/a'
     WHEN l_linenumber = 5 THEN '   '
     ELSE '  9606.P' || l_partkey || '   9606.S' || l_suppkey || ' ' || (CAST(l_quantity AS BIGINT) * 20) || ' extra' END"""


@query("src_parse_ws_lines", """
SELECT '9606.P' || l_partkey AS src, '9606.S' || l_suppkey AS dst, CAST(CAST(l_quantity AS BIGINT) * 20 AS DOUBLE) AS score FROM lineitem
WHERE NOT ((l_linenumber = 1 AND l_returnflag = 'N') OR (l_linenumber = 2 AND l_returnflag = 'A') OR (l_linenumber = 3 AND l_returnflag = 'R')
           OR (l_linenumber = 4 AND l_returnflag = 'A') OR l_linenumber = 5)""")
def src_parse_ws_lines(spark, sf):
    return files.parse_edge_lines(tab(spark, sf, "lineitem").select(F.expr(_LINK_LINE).alias("value")))


_ALIAS_LINE = """
CASE p_size % 6 WHEN 0 THEN '#string_protein_id\talias\tsource' WHEN 1 THEN 'string_protein_id alias source'
     WHEN 2 THEN 'P' || p_partkey || '\t' || p_name || '\t' || p_type WHEN 3 THEN 'P' || p_partkey || '  ' || p_brand || ' ' || p_type
     WHEN 4 THEN 'P' || p_partkey || '\t' || p_brand ELSE 'P' || p_partkey || '\t' || p_name || ' ' || p_type END"""


@query("src_parse_tab_or_ws", """
SELECT 'P' || p_partkey AS protein_id, p_name AS alias_value, p_type AS source FROM part WHERE p_size % 6 = 2
UNION ALL SELECT 'P' || p_partkey, p_brand, p_type FROM part WHERE p_size % 6 = 3
UNION ALL SELECT 'P' || p_partkey, split_part(p_name, ' ', 1), split_part(p_name, ' ', 2) FROM part WHERE p_size % 6 = 5""")
def src_parse_tab_or_ws(spark, sf):
    return files.parse_alias_lines(tab(spark, sf, "part").select(F.expr(_ALIAS_LINE).alias("value")))


@query("src_section_from_header", f"""
WITH l AS ({SQL_LINES}), f AS (SELECT doc_id, min(pos) AS first_pos FROM l WHERE starts_with(line, 'The') GROUP BY doc_id)
SELECT l.doc_id, min(l.pos) AS first_pos, count(*) AS n_lines, CAST(sum(length(l.line)) AS BIGINT) AS n_chars
FROM l JOIN f ON l.doc_id = f.doc_id AND l.pos >= f.first_pos GROUP BY l.doc_id""")
def src_section_from_header(spark, sf):
    body = files.section_from(doc_lines(spark, sf), ["doc_id"], "pos", F.col("line").startswith("The"))
    return body.groupBy("doc_id").agg(
        big(F.min("pos")).alias("first_pos"), F.count(F.lit(1)).alias("n_lines"), big(F.sum(F.length("line"))).alias("n_chars")
    )


@query("src_section_between", """
WITH b AS (SELECT conv_id, min(turn) AS b FROM conversations WHERE role = 'user' GROUP BY conv_id),
e AS (SELECT c.conv_id, min(b.b) AS b, min(turn) AS e FROM conversations c JOIN b ON c.conv_id = b.conv_id AND c.turn > b.b WHERE role = 'user' GROUP BY c.conv_id)
SELECT c.conv_id, c.turn, c.role, length(c.text) AS n_chars FROM conversations c JOIN e ON c.conv_id = e.conv_id AND c.turn > e.b AND c.turn < e.e""")
def src_section_between(spark, sf):
    user = F.col("role") == "user"
    inside = files.section_between(tab(spark, sf, "conversations"), ["conv_id"], "turn", user, user)
    return inside.select("conv_id", "turn", "role", big(F.length("text")).alias("n_chars"))


@query("src_parquet_scan", """
SELECT l_returnflag, count(*) AS n_rows, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM lineitem WHERE l_quantity >= 10 GROUP BY l_returnflag""")
def src_parquet_scan(spark, sf):
    rows = tables.read_table(spark, f"{sf}/lineitem.parquet").where("l_quantity >= 10")
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_rows"), money("l_extendedprice").alias("total"))


@query("src_table_or_path", """
SELECT 'view' AS origin, count(*) AS n_rows FROM orders UNION ALL SELECT 'path', count(*) FROM customer""")
def src_table_or_path(spark, sf):
    tab(spark, sf, "orders").createOrReplaceTempView("provenor_orders")
    present = tables.read_table_or_path(spark, "provenor_orders", f"{sf}/customer.parquet")
    absent = tables.read_table_or_path(spark, "provenor_no_such_table", f"{sf}/customer.parquet")
    n = F.count(F.lit(1)).alias("n_rows")
    return present.agg(n).select(F.lit("view").alias("origin"), "n_rows").unionByName(absent.agg(n).select(F.lit("path").alias("origin"), "n_rows"))


@query("src_snapshot_items", """
SELECT event_id, event_type AS name, value FROM events
UNION ALL SELECT event_id, 'k', CAST(json_extract(props, '$.k') AS DOUBLE) FROM events""")
def src_snapshot_items(spark, sf):
    item = "array<struct<event_id: bigint, name: string, value: double>>"
    k = F.get_json_object("props", "$.k").cast("double")
    payload = tab(spark, sf, "events").select(F.to_json(F.struct(F.array(
        F.struct("event_id", F.col("event_type").alias("name"), "value"),
        F.struct("event_id", F.lit("k").alias("name"), k.alias("value")),
    ).alias("items"), F.lit("events").alias("source"))).alias("doc"))
    parsed = payload.select(F.from_json("doc", f"items {item}, source string").alias("d")).select("d.*")
    return tables.snapshot_rows(parsed)


@query("src_manifest_plan", """
SELECT s_name AS filename, '/raw/' || 'nation' || s_nationkey || '/run_date=2024-01-07/' || s_name AS raw_path,
       '/raw/metadata/file_index/run_date=2024-01-07' AS index_dir, '/raw/metadata/error/run_date=2024-01-07' AS error_dir FROM supplier""")
def src_manifest_plan(spark, sf):
    manifest = tab(spark, sf, "supplier").select(
        F.col("s_name").alias("filename"), F.concat(F.lit("nation"), "s_nationkey").alias("hdfs_subdir")
    )
    return landing.plan_manifest(manifest, "/raw", "2024-01-07").select("filename", "raw_path", "index_dir", "error_dir")


@query("src_landed_audit", """
WITH l AS (SELECT l_orderkey, count(*) AS size FROM lineitem GROUP BY l_orderkey),
m AS (SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderkey % 7 + 1 END AS size FROM orders)
SELECT CASE WHEN l.l_orderkey IS NULL THEN 'missing' WHEN m.size IS NOT NULL AND m.size <> l.size THEN 'mismatched' ELSE 'matched' END AS status,
       count(*) AS n, min(m.o_orderkey) AS first_key FROM m LEFT JOIN l ON m.o_orderkey = l.l_orderkey GROUP BY 1""")
def src_landed_audit(spark, sf):
    manifest = tab(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderkey") % 7 + 1).alias("size")
    )
    landed = tab(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count(F.lit(1)).alias("size"))
    return landing.index_landed(manifest, landed, "key", ["size"]).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key")
    )


def _text_files(lines, spark, label):
    """Writes (file, pos, value) as one text file per ``file``, in order, and returns the folder."""
    path = working_path(spark, label)
    lines.repartition("file").sortWithinPartitions("file", "pos").select("file", "value").write.partitionBy("file").text(path)
    return path


def _supplier_lines(spark, sf):
    """Supplier rows in two files, by key; the second file has its columns in another order."""
    odd = F.col("s_suppkey") % 2 == 1
    cells = F.when(odd, F.concat_ws("\t", "s_suppkey", "s_name", "s_nationkey")).otherwise(F.concat_ws("\t", "s_suppkey", "s_nationkey", "s_name"))
    rows = tab(spark, sf, "supplier").select(F.when(odd, "a").otherwise("b").alias("file"), (F.col("s_suppkey") + 10).alias("pos"), cells.alias("value"))
    return rows, ["ID_REF\tname\tnation", "ID_REF\tnation\tname"]


def _with_lines(spark, rows, extra):
    return rows.unionByName(spark.createDataFrame(extra, "file string, pos bigint, value string"))


@query("src_read_from_header", "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier")
def src_read_from_header(spark, sf):
    rows, heads = _supplier_lines(spark, sf)
    extra = [(f, i, v) for f, head in zip("ab", heads) for i, v in ((0, "intro"), (1, "ID_REFERENCE"), (2, head))]
    got = files.read_from_header(spark, _text_files(_with_lines(spark, rows, extra), spark, "matrix"), "ID_REF\t")
    return got.select(F.col("ID_REF").alias("id"), "name", "nation")


@query("src_read_between", "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier")
def src_read_between(spark, sf):
    rows, heads = _supplier_lines(spark, sf)
    last = 2**40
    extra = [(f, i, v) for f, head in zip("ab", heads) for i, v in ((0, "!end"), (1, "!begin"), (2, head), (last, "!end"), (last + 1, "after"), (last + 2, "!end"))]
    got = files.read_between(spark, _text_files(_with_lines(spark, rows, extra), spark, "sections"), "!begin", "!end")
    return got.select(F.col("ID_REF").alias("id"), "name", "nation")


@query("src_read_counts", "SELECT 'n' || s_nationkey AS file_id, s_name AS gene, CAST(s_suppkey AS VARCHAR) AS n FROM supplier")
def src_read_counts(spark, sf):
    supplier = tab(spark, sf, "supplier")
    rows = supplier.select(F.concat(F.lit("n"), "s_nationkey").alias("file"), (F.col("s_suppkey") + 10).alias("pos"), F.concat_ws("\t", "s_name", "s_suppkey").alias("value"))
    heads = supplier.select(F.concat(F.lit("n"), "s_nationkey").alias("file")).distinct().select(
        "file", F.inline(F.array(F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit("# comment").alias("value")), F.struct(F.lit(1).cast("bigint").alias("pos"), F.lit("gene\tn").alias("value"))))
    )
    path = _text_files(rows.unionByName(heads), spark, "counts")
    return files.read_counts(spark, path, id_pattern=r"file=([^/]+)").select("file_id", "gene", "n")


@query("src_read_tsv", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def src_read_tsv(spark, sf):
    path = working_path(spark, "table")
    tab(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment").write.option("sep", "\t").option("header", True).csv(path)
    return files.read_tsv(spark, path)


@query("src_read_nested_index", "SELECT 'F' || o_orderkey AS file_id, 'C' || o_custkey AS case_id, 'S' || o_orderkey AS sample_id FROM orders")
def src_read_nested_index(spark, sf):
    sample = F.struct(F.concat(F.lit("S"), "o_orderkey").alias("sample_id"), F.lit("Primary Tumor").alias("sample_type"))
    case = F.struct(F.concat(F.lit("C"), "o_custkey").alias("case_id"), F.array(sample).alias("samples"))
    hit = F.struct(F.concat(F.lit("F"), "o_orderkey").alias("file_id"), F.array(case).alias("cases"))
    path = working_path(spark, "index")
    tab(spark, sf, "orders").select(F.struct(F.array(hit).alias("hits")).alias("data")).write.json(path)
    return files.read_nested_index(spark, path, multi_line=False).select("file_id", "case_id", "sample_id")


@query("src_read_edge_text", "SELECT 'P' || l_partkey AS src, 'S' || l_suppkey AS dst, CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) AS score FROM lineitem")
def src_read_edge_text(spark, sf):
    path = working_path(spark, "links")
    tab(spark, sf, "lineitem").select(F.concat(F.lit("P"), "l_partkey", F.lit("  S"), "l_suppkey", F.lit(" "), big("l_quantity"))).write.text(path)
    return files.read_edge_text(spark, path)


@query("src_read_alias_text", "SELECT 'P' || p_partkey AS protein_id, p_name AS alias_value, p_type AS source FROM part")
def src_read_alias_text(spark, sf):
    path = working_path(spark, "aliases")
    tab(spark, sf, "part").select(F.concat_ws("\t", F.concat(F.lit("P"), "p_partkey"), "p_name", "p_type")).write.text(path)
    return files.read_alias_text(spark, path)


@query("src_line_digests", """
SELECT file, count(*) AS n_lines, count(*) = max(total) AS whole FROM (SELECT 'n' || (c_nationkey % 3) AS file, count(*) OVER (PARTITION BY c_nationkey % 3) AS total FROM customer) GROUP BY file""")
def src_line_digests(spark, sf):
    """Two copies of the same lines, written in different orders, have the same digests."""
    lines = tab(spark, sf, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey") % 3).alias("file"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("value"))
    found = []
    for order in (F.col("pos"), -F.col("pos")):
        digests = landing.line_digests(spark, _text_files(lines.withColumn("pos", order), spark, "digests")).groupBy("n_lines").agg(F.collect_set("digest").alias("digest"))
        found.append(digests)
    sizes = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"))
    same = found[0].join(found[1].withColumnRenamed("digest", "again"), "n_lines").select("n_lines", F.array_sort("digest").eqNullSafe(F.array_sort("again")).alias("whole"))
    return sizes.join(same, "n_lines", "left").select("file", "n_lines", F.coalesce("whole", F.lit(False)).alias("whole"))
