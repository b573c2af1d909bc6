"""Plan shapes and balance that decide whether an operator survives large data."""

import pytest
from pyspark.sql import functions as F

from provenor.catalogue import QUERIES
from provenor.catalogue.base import tab, x_edges
from provenor.operators import aggregates, filters, graph, joins, ordering, scoring, sorting, windows

SF = "/root/testdata/sf0.001"


def plan(df, capsys):
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


@pytest.fixture(scope="module")
def hot(spark):
    """300k rows; one key holds a third of them and a third of the values are equal."""
    rows = spark.range(300_000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 1000)).alias("k"),
        F.when(F.xxhash64("id") % 3 == 0, 1.0).otherwise((F.abs(F.xxhash64("id")) % 100000).cast("double")).alias("v"),
    )
    return rows


@pytest.fixture()
def fixed_partitions(spark):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_hot_key_and_hot_value_are_spread_over_slices(hot, fixed_partitions):
    for keys in (["k"], []):
        sliced = ordering._slices(hot, keys, [F.col("v").asc(), F.col("id").asc()])
        sizes = [r["count"] for r in sliced.groupBy("__slice").count().collect()]
        assert len(sizes) == 8 and max(sizes) < 2 * 300_000 / 8


def test_salts_spread_a_hot_join_key(spark, hot, fixed_partitions):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dim = hot.select("k").distinct().withColumn("w", F.lit(1))
        joined = joins.keyed_join(hot, dim, ["k"], salts=32).groupBy(F.spark_partition_id().alias("p")).count()
        sizes = [r["count"] for r in joined.collect()]
        assert sum(sizes) == 300_000 and max(sizes) < 2.5 * 300_000 / 8
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("n,sent", [(20_000, False), (20, True)])
def test_salted_copies_are_broadcast_by_the_size_of_all_copies(spark, hot, n, sent):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2m")
    try:
        fact = hot.select(F.col("id").alias("key"), "v")
        dim = spark.range(2 * n).groupBy((F.col("id") % n).alias("key")).agg(F.min("id").alias("w"))
        joined = joins.keyed_join(fact, dim, ["key"], "left", salts=32)
        assert sum(r["w"] is not None and r["w"] == r["key"] for r in joined.collect()) == n
        assert ("BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()) == sent
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_best_row_is_limited_before_the_shuffle(spark, capsys):
    rows = tab(spark, SF, "lineitem")
    text = plan(windows.best_by(rows, ["l_suppkey"], [F.col("l_quantity").desc(), F.col("l_orderkey")]), capsys)
    assert text.count("WindowGroupLimit") >= 2


def test_top_k_is_a_merge_of_partial_results(spark, capsys):
    text = plan(sorting.top_k(tab(spark, SF, "orders"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 10), capsys)
    assert "TakeOrderedAndProject" in text


def test_scan_reads_only_what_is_needed(spark, capsys):
    text = plan(filters.min_weight(tab(spark, SF, "lineitem").select("l_partkey", "l_quantity"), "l_quantity", 40), capsys)
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThanOrEqual(l_quantity,40.0)]" in text
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double>" in text
    edges = plan(graph.degrees(x_edges(spark, SF), "src", "dst", "weight"), capsys)
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_quantity:double>" in edges


def test_histogram_is_one_pass(spark, capsys):
    text = plan(aggregates.histogram(tab(spark, SF, "lineitem"), "l_quantity", [0, 10, 20, 50], group="l_returnflag"), capsys)
    assert text.count("Scan parquet") == 2  # once in the tree, once in the details
    assert "Join" not in text


def test_global_statistics_are_one_subquery(spark, capsys):
    scaled = scoring.minmax(tab(spark, SF, "part").select("p_retailprice", "p_size"), {"p_retailprice": "a", "p_size": "b"})
    text = plan(scaled, capsys)
    assert "Join" not in text
    assert text.count("Hosting operator id") == 1


@pytest.mark.parametrize("name", [
    "jon_incident_edges", "jon_induced_subgraph", "jon_both_ends", "jon_entity_mentions", "agg_histogram", "agg_iqr_flags", "win_percent_rank",
    "win_global_rank", "win_support_rank", "win_context_budget", "sco_candidate_features", "sco_cohort_support", "rsh_heatmap", "agg_cluster_explain",
])
def test_no_product_of_tables(spark, capsys, name):
    text = plan(QUERIES[name](spark, SF), capsys)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_no_python_in_the_hot_path(spark, capsys):
    for name in ("agg_two_group_test", "src_parse_ws_lines", "jon_norm_key_map", "agg_sample_qc"):
        assert "Python" not in plan(QUERIES[name](spark, SF), capsys)


@pytest.mark.parametrize("name,times", [
    ("agg_neighbour_features", 2), ("agg_degree", 2), ("agg_rollups", 2), ("win_canonical_edges", 4), ("step_protein_nodes", 2), ("step_gene_edges", 1),
])
def test_tasks_of_edge_steps_grow_with_the_edges(spark, capsys, monkeypatch, name, times):
    """Not with the session's shuffle partitions, which stay as they are."""
    from provenor import session

    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    n = tab(spark, SF, "lineitem").count()
    text = plan(QUERIES[name](spark, SF), capsys)
    for tasks in (-(-n // 100), -(-n * times // 100)):
        assert f", {tasks}), REPARTITION_BY_NUM" in text
