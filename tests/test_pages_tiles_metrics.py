"""Deep pages, tiles of nearest passages and metrics of a write."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from provenor.operators import filters, ordering, retrieval, sorting
from provenor.sinks import tables as sinks
from provenor.sources.tables import read_table


@pytest.fixture(scope="module")
def numbers(spark):
    """200k rows in a mixed order; a third of them share one value, some have none."""
    v = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 1000 == 1, F.lit(None)).otherwise(F.pmod(F.xxhash64("id"), F.lit(5000)))
    return spark.range(200_000, numPartitions=6).select("id", v.cast("int").alias("v"))


def order():
    return [F.col("v").desc_nulls_last(), F.col("id").asc()]


@pytest.fixture(scope="module")
def in_order(numbers):
    return [tuple(r) for r in sorted(numbers.collect(), key=lambda r: (r["v"] is None, -(r["v"] or 0), r["id"]))]


@pytest.fixture()
def no_merging(spark):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_pages_of_a_stored_order(spark, numbers, in_order, no_merging):
    pages = ordering.store_pages(numbers, order())
    assert pages.total == 200_000 and len(pages.slices) > 4
    edges = [before for _, _, before, _ in pages.slices[1:3]]
    for limit, offset in [(10, 0), (25, 199_990), (50, 123_456), (5, 200_000), (0, 10), *[(20, e - 10) for e in edges]]:
        assert [tuple(r) for r in pages.page(limit, offset).collect()] == in_order[offset : offset + limit]


def test_a_page_opens_only_its_slices(spark, numbers, no_merging, capsys):
    pages = ordering.store_pages(numbers, order())
    deep = pages.page(25, 150_000)
    deep.collect()
    capsys.readouterr()
    deep.explain("formatted")
    text = capsys.readouterr().out
    assert "PartitionFilters: [" in text and "__slice" in text.split("PartitionFilters: [")[1].split("]")[0] and "__place" in text.split("PushedFilters: [")[1].split("]")[0]
    nodes = deep._jdf.queryExecution().executedPlan().toString()
    assert "Scan" in nodes
    files = spark.read.schema(pages.schema).parquet(pages.path).where(F.col("__slice").isin([n for n, _, b, r in pages.slices if b < 150_025 and b + r > 150_000])).select("_metadata.file_path").distinct().count()
    assert files <= 2 < len(pages.slices)


def test_page_and_page_after_agree_with_one_sort(spark, numbers, in_order):
    for limit, offset in [(30, 20), (30, 9_990), (30, 150_000), (30, 199_999)]:
        assert [tuple(r) for r in sorting.page(numbers, order(), limit, offset).collect()] == in_order[offset : offset + limit]
    known = numbers.where("v IS NOT NULL")
    keys, last, seen = [("v", True), ("id", False)], None, []
    for _ in range(4):
        rows = [tuple(r) for r in sorting.page_after(known, keys, last, 40).collect()]
        seen += rows
        last = (rows[-1][1], rows[-1][0])
    assert seen == in_order[:160]
    assert sorting.page_after(known, keys, (-1, 0), 5).count() == 0


def test_deep_search_page(spark, numbers, in_order, monkeypatch):
    want = [r for r in in_order if r[1] is not None and r[1] >= 7]
    monkeypatch.setattr(sorting, "SHALLOW_ROWS", 100)
    got = filters.search_targets(numbers, "id", 20, 60_000, min_score=("v", 7))
    expected = sorted(r[0] for r in want)
    assert [r["id"] for r in got.collect()] == expected[60_000:60_020] and got.first()["total"] == len(expected)
    empty = ordering.store_pages(numbers.where("id < 0"), order())
    assert empty.total == 0 and empty.page(10).count() == 0


def test_memory_of_tiles_does_not_grow_with_questions(tmp_path):
    """A million questions against a chunk of passages; candidates are passed on block by block."""
    n, rng = 1_000_000, np.random.default_rng(1)
    vec = rng.normal(size=(n, 2)).ravel()
    table = pa.table({"question": np.arange(n), "vec": pa.FixedSizeListArray.from_arrays(pa.array(vec), 2).cast(pa.list_(pa.float64()))})
    path = tmp_path / "q.parquet"
    pq.write_table(table, path, row_group_size=65_536)
    points = rng.normal(size=(64, 2))
    passages = pa.RecordBatch.from_arrays([pa.array(np.arange(64)), pa.array(points.tolist(), pa.list_(pa.float64()))], ["passage", "vec"])
    del table
    tracemalloc.start()
    rows, best = 0, None
    for out in retrieval.tiles(iter([passages]), lambda: retrieval._question_blocks([path.as_uri()], 1024), 6, 1 << 20):
        rows += out.num_rows
        best = best if best is not None else out
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 6 * n and peak < 32e6
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    distance = 1 - unit(vec.reshape(-1, 2)[:1024]) @ unit(points).T
    want = {(i, int(j)) for i in range(1024) for j in np.argsort(distance[i], kind="stable")[:6]}
    assert set(zip(best.column("question").to_pylist(), best.column("passage").to_pylist(), strict=True)) == want


@pytest.mark.parametrize("sizes", [{"passage_bytes": 1}, {"passage_bytes": 4000, "question_block": 5}, {}])
def test_tiles_of_any_size_agree(spark, monkeypatch, sizes):
    monkeypatch.setattr(retrieval, "TILE_CELLS", 64)
    rng = np.random.default_rng(4)
    q, p = rng.normal(size=(23, 6)), rng.normal(size=(400, 6))
    p[50:100] = p[7]  # many ties
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(99, None)], "qid int, v array<double>")
    ps = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(p)], "pid int, v array<double>").repartition(5)
    d = np.round(1 - (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (p / np.linalg.norm(p, axis=1, keepdims=True)).T, 12)
    want = {(i, int(j), r) for i in range(23) for r, j in enumerate(np.lexsort((np.arange(400), d[i]))[:6], 1)}
    got = retrieval.cosine_topk(qs, ps, "qid", "v", "pid", "v", k=6, **sizes)
    assert {(r["question"], r["passage"], r["place"]) for r in got.collect()} == want


def test_metrics_of_a_write_need_no_second_pass(spark, numbers, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    counted = numbers.mapInArrow(count, "id bigint, v int")
    specs = {"rows": (F.count(F.lit(1)), "all"), "without": (F.count_if(F.col("v").isNull()), "no value"), "mean": (F.round(F.avg("v"), 6), "mean value"), "top": (F.max("v"), "largest")}
    path = str(tmp_path / "out")
    got = sinks.write_observed(counted, path, specs).drop("created_at").collect()
    assert reads.value == 200_000
    assert sorted(map(tuple, got)) == sorted(map(tuple, sinks.metrics_table(numbers, specs).drop("created_at").collect()))
    assert read_table(spark, path).count() == 200_000
    sized = sinks.write_observed(numbers.withColumn("g", F.col("id") % 2), str(tmp_path / "parts"), {"rows": specs["rows"]}, partition_by=["g"], sized=True).first()
    assert sized["metric_value"] == "200000" and sized["created_at"].endswith("Z")
    none = sinks.write_observed(numbers.where("id < 0"), str(tmp_path / "none"), {"rows": specs["rows"], "top": specs["top"]}).collect()
    assert [r["metric_value"] for r in none] == ["0", None]
