import math
import random

import pytest
from pyspark.sql import functions as F

from provenor.operators import aggregates as agg
from provenor.operators import filters, graph, joins, ml, ordering, quality, retrieval, scoring, sets, shape, sorting, stats, windows


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows; a third of the values are equal; some keys are null."""
    rnd = random.Random(7)
    data = [(i, "hot" if i % 3 == 0 else rnd.choice([None, "a", "b", "c"]), 5.0 if rnd.random() < 0.34 else round(rnd.uniform(0, 100), 2), rnd.randint(0, 9)) for i in range(6000)]
    return data, spark.createDataFrame(data, "id int, k string, v double, n int")


@pytest.fixture()
def many_slices(spark):
    """Small partitions stay apart, so that keys really do span slices."""
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_number_rows_over_hot_keys(spark, skewed, many_slices):
    data, df = skewed
    got = ordering.number_rows(df, [F.col("v").desc(), F.col("id").asc()], ["k"], "pos", "total", {"run": "n"})
    groups = {}
    for row in sorted(data, key=lambda r: (-r[2], r[0])):
        groups.setdefault(row[1], []).append(row)
    want = {}
    for rows in groups.values():
        run = 0
        for i, r in enumerate(rows, 1):
            run += r[3]
            want[r[0]] = (i, len(rows), run)
    assert {r.id: (r.pos, r.total, r.run) for r in got.collect()} == want


def test_overall_order_spans_slices(spark, skewed, many_slices):
    data, df = skewed
    ranked = sorting.global_rank(df, [F.col("v").asc(), F.col("id").asc()])
    order = [r[0] for r in sorted(data, key=lambda r: (r[2], r[0]))]
    assert {r.id: r["rank"] for r in ranked.collect()} == {i: n for n, i in enumerate(order, 1)}
    prev = ordering.with_previous(df, [F.col("v").asc(), F.col("id").asc()], ["id"])
    assert {r.id: r.prev_id for r in prev.collect()} == dict(zip(order, [None, *order]))


def test_previous_per_key(spark, skewed, many_slices):
    data, df = skewed
    want = {}
    last = {}
    for r in sorted(data, key=lambda r: (r[2], r[0])):
        want[r[0]] = last.get(r[1])
        last[r[1]] = r[0]
    got = ordering.with_previous(df, [F.col("v").asc(), F.col("id").asc()], ["id"], keys=["k"])
    assert {r.id: r.prev_id for r in got.collect()} == want


def test_exact_quantiles(spark, skewed, many_slices):
    import numpy as np

    data, df = skewed
    got = {r.k: (r.q1, r.med) for r in ordering.exact_quantiles(df, ["k"], "v", {"q1": 0.25, "med": 0.5}).collect()}
    for k in {r[1] for r in data}:
        vals = [r[2] for r in data if r[1] == k]
        assert got[k] == (pytest.approx(np.quantile(vals, 0.25)), pytest.approx(np.quantile(vals, 0.5)))


def test_salted_join_equals_plain(spark, skewed, rows):
    _, df = skewed
    dim = spark.createDataFrame([("hot", 1), ("a", 2), ("z", 3)], "k string, w int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = rows(joins.keyed_join(df, dim, ["k"], how).groupBy("k").count())
        assert rows(joins.keyed_join(df, dim, ["k"], how, salts=5).groupBy("k").count()) == plain
    with pytest.raises(ValueError):
        joins.keyed_join(df, dim, ["k"], "full_outer", salts=2)


def test_iqr_flags_need_spread(spark):
    flat = spark.createDataFrame([(i, 5) for i in range(20)] + [(99, 500)], "id int, v int")
    assert agg.iqr_flags(flat, {"v": "out"}).where("out").count() == 0
    wide = spark.createDataFrame([(i, i) for i in range(20)] + [(99, 500)], "id int, v int")
    assert [r.id for r in agg.iqr_flags(wide, {"v": "out"}).where("out").collect()] == [99]


def test_two_group_edge_cases(spark):
    data = [("one", "case", 1.0), ("one", "control", 2.0), ("one", "control", 3.0), ("flat", "case", 1.0), ("flat", "case", 1.0), ("flat", "control", 4.0), ("flat", "control", 4.0), ("solo", "case", 1.0)]
    df = spark.createDataFrame(data, "gene string, g string, v double")
    got = {r.gene: r for r in stats.call_diff(stats.two_group_test(df, ["gene"], "g", "v", "v", "case", "control")).collect()}
    assert set(got) == {"one", "flat"}
    assert got["one"].t_stat is None and got["one"].p_value is None and got["one"].is_different is False
    assert got["flat"].effect == -3.0 and got["flat"].p_value is None and got["flat"].direction == "Downregulated"
    with pytest.raises(ValueError):
        stats.check_groups(df.withColumn("s", F.lit(1)), "g", "s", "case", "control")


@pytest.mark.parametrize("fc,p,want", [(2.0, 0.001, True), (0.4, 0.001, False), (1.5, 0.20, False), (-1.2, 0.01, True), (3.0, None, False)])
def test_call(spark, fc, p, want):
    df = spark.createDataFrame([(fc, p)], "effect double, p_value double")
    assert stats.call_diff(df).first().is_different is want


def test_canonical_edges(spark):
    df = spark.createDataFrame([("B", "A", "eb", "ea", 500.0), ("A", "B", "e1", "e2", 700.0), ("A", "A", "x", "x", 9.0), ("A", None, "x", None, 1.0)], "s string, d string, es string, ed string, w double").withColumn("w2", F.col("w") / 1000)
    got = windows.canonical_edges(df, "s", "d", [("es", "ed")], "w", "w2", ("es", "ed")).collect()
    assert [tuple(r) for r in got] == [("A", "B", "e1", "e2", 700.0, 0.7, 2)]


def test_degree_and_features(spark):
    e = spark.createDataFrame([("a", "b", 500.0, 0.5), ("b", "a", 500.0, 0.5)], "s string, d string, score double, w double")
    assert {r.node: (r.degree, r.weighted_degree) for r in graph.degrees(e, "s", "d", "w").collect()} == {"a": (1, 1.0), "b": (1, 1.0)}
    assert {r.node: r.weighted_degree for r in graph.degrees(e, "s", "d", "w", dedup=True).collect()} == {"a": 0.5, "b": 0.5}
    f = graph.interaction_features(e, spark.createDataFrame([("a",)], "node string"), "node", "s", "d", "score", "w").collect()
    assert [(r.node, r.n_interactions, r.avg_score, r.n_high) for r in f] == [("a", 1, 500.0, 0)]


def test_ego_network_order_of_filters(spark):
    nodes = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("c", 3, "y"), ("d", 4, "x")], "id string, rank int, t string")
    edges = spark.createDataFrame([("a", "b", 0.1), ("d", "a", 0.9), ("b", "a", 0.8)], "s string, d string, w double")
    n, e = graph.ego_network(nodes, edges, "id", "a", "s", "d", "w", "rank", 3, keep=F.col("t") == "x")
    assert sorted(r.id for r in n.collect()) == ["a", "b"]
    assert [tuple(r) for r in e.select("s", "d").collect()] == [("b", "a")]


def test_histogram_is_half_open(spark, rows):
    df = spark.createDataFrame([(0.4,), (0.5,), (1.0,), (1.01,)], "v double")
    assert rows(agg.histogram(df, "v", [0.4, 0.5, 1.01])) == [(0.4, 0.5, 1), (0.5, 1.01, 2)]
    assert rows(agg.histogram(df, "v", [2.0, 3.0])) == [(2.0, 3.0, 0)]
    assert agg.histogram(df.withColumn("g", F.lit(1)), "v", [2.0, 3.0], group="g").count() == 0


def test_best_evidence(spark):
    df = spark.createDataFrame([("P", 2.0, 0.01, "B"), ("P", -2.0, None, "A"), ("P", 1.0, 0.0, "C")], "k string, fc double, p double, g string")
    got = windows.best_by(df, ["k"], [F.abs("fc").desc(), F.col("p").asc_nulls_last(), F.col("g")]).collect()
    assert [r.g for r in got] == ["B"]


def test_percentiles(spark):
    df = spark.createDataFrame([("s1", f"g{i}", float(i)) for i in range(5)] + [("s2", "g0", 3.0)], "s string, g string, v double")
    got = {(r.s, r.g): (r.percentile, r.is_top_quartile) for r in windows.within_percentile(df, ["s"], "v", "g").collect()}
    assert [got[("s1", f"g{i}")][0] for i in range(5)] == [0.0, 0.25, 0.5, 0.75, 1.0]
    assert got[("s2", "g0")] == (1.0, True)


@pytest.mark.parametrize("lengths,budget,kept", [([10, 15, 3], 20, 1), ([30, 1], 20, 1), ([10, 10, 1], 20, 2), ([5, 5], 20, 2)])
def test_context_budget(spark, lengths, budget, kept):
    df = spark.createDataFrame([("q", i, n) for i, n in enumerate(lengths)], "q string, i int, n int")
    assert windows.pack_context(df, ["q"], [F.col("i")], "n", budget).count() == kept


def test_minmax_constant_and_support_levels(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0)], "a double, b double")
    assert sorted(tuple(r) for r in scoring.minmax(df, {"a": "x", "b": "y"}).select("x", "y").collect()) == [(0.0, 0.0), (1.0, 0.0)]
    scores = spark.createDataFrame([(0.75, True), (0.5, True), (0.4999, True), (None, False)], "s double, f boolean")
    got = [r[0] for r in scores.select(scoring.support_level(F.col("s"), F.col("f"))).collect()]
    assert got == ["Strong GEO support", "Moderate GEO support", "Limited GEO support", "Not Found"]


def test_wide_groups(spark):
    df = spark.createDataFrame([("c1", "s1", "t1", "u1", "s2", "t2"), ("c2", " ", None, None, None, "t3")], "case_id string, `samples.0.sample_id` string, `samples.0.sample_type` string, `samples.0.tissue_type` string, `samples.10.sample_id` string, `samples.10.sample_type` string")
    got = {tuple(r) for r in shape.wide_groups_to_long(df, "case_id", ["sample_id", "sample_type", "tissue_type"]).collect()}
    assert got == {("c1", "s1", "t1", "u1"), ("c1", "s2", "t2", None)}
    assert shape.wide_groups_to_long(df.select("case_id"), "case_id", ["sample_id"]).count() == 0


def test_search_semantics(spark):
    df = spark.createDataFrame([(1, "TP53", "P1", "E1", "Expression-driven", "Moderate GEO support", "Upregulated", 0.9), (2, "EGFR", "P2", "E2", "Network-driven", "Moderate", "Downregulated", None)], "rank int, gene_name string, protein_id string, ensp_id string, candidate_group string, geo_support_level string, deg_direction string, final_score double")
    assert [r["rank"] for r in filters.search_targets(df, "rank", 10, contains={"candidate_group": "DRIVEN"}).collect()] == [1, 2]
    assert [r["rank"] for r in filters.search_targets(df, "rank", 10, equals={"geo_support_level": "moderate geo support"}).collect()] == [1]
    assert [(r["rank"], r.total) for r in filters.search_targets(df, "rank", 1, 1, search="p").collect()] == [(2, 2)]
    assert filters.search_total(df, min_score=("final_score", 0.1)).first().total == 1


def test_entity_mentions_brute_force(spark):
    import re

    entries = [("P1", "TP53", "9606.ENSP1"), ("P2", "A b", "X.Y-Z"), ("P3", "++!", "QQQ"), ("P4", "(x) cell", "ab"), ("P5", "B-CELL", "9606.ENSP2")]
    texts = [
        "tp53 and 9606.ENSP1x, also x.y-z!", "TP53. is not tp53-like; a b", "aa b; A B; c++!d", "see (x) cell or (X) cells", "b-cell b-cells z9606.ensp2",
        "nothing", "", "  +++!  ", "TP53", "see é(x) cell",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    df = spark.createDataFrame(entries, "pid string, name string, other string").withColumn("rank", F.substring("pid", 2, 1).cast("int"))
    got = {(r.doc, r.pid) for r in joins.entity_mentions(docs, "doc", "text", df, ["name", "other"], "pid", [F.col("rank")]).collect()}
    want = set()
    for d, text in enumerate(texts):
        hay = text.upper()
        for pid, *names in entries:
            for n in (x.strip().upper() for x in names):
                if len(n) >= 3 and (re.search(rf"(?<![A-Z0-9_.-]){re.escape(n)}(?![A-Z0-9_.-])", hay) or (n.startswith("9606.") and n in hay)):
                    want.add((d, pid))
    assert got == want
    assert joins.entity_mentions(docs, "doc", "text", df, ["name", "other"], "pid", [F.col("rank")], limit=1).groupBy("doc").count().where("count > 1").count() == 0


def test_cosine_forms_agree_with_brute_force(spark):
    import numpy as np

    rnd = np.random.default_rng(3)
    q, p = rnd.normal(size=(7, 5)), rnd.normal(size=(50, 5))
    p[9] = p[3]
    qs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "qid int, v array<double>")
    ps = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(p)], "pid int, v array<double>")
    dist = 1 - (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (p / np.linalg.norm(p, axis=1, keepdims=True)).T
    want = {(i, int(j), r) for i in range(7) for r, j in enumerate(sorted(range(50), key=lambda j: (round(dist[i, j], 12), j))[:4], 1)}
    for sizes in ({}, {"question_block": 3}):
        got = retrieval.cosine_topk(qs, ps, "qid", "v", "pid", "v", k=4, **sizes)
        assert {(r.question, r.passage, r.place) for r in got.collect()} == want
    zeros = spark.createDataFrame([(f"p{i:04d}", [0.0] * 5) for i in range(3000)], "pid string, v array<double>")
    assert sorted(r.passage for r in retrieval.cosine_topk(qs.where("qid = 1"), zeros, "qid", "v", "pid", "v", k=3).collect()) == ["p0000", "p0001", "p0002"]
    plan = retrieval.cosine_topk(qs, ps, "qid", "v", "pid", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "RepartitionByExpression" not in plan
    assert retrieval.cosine_topk(qs, ps.limit(2), "qid", "v", "pid", "v", k=4).count() == 14
    assert retrieval.cosine_topk(qs.limit(0), ps, "qid", "v", "pid", "v").count() == 0


def test_sections(spark):
    text = "intro\n## KB-001: First title \n**chunk_id:** `one`\n**keywords:** `a, b`\nbody\n## KB-02: bad\n\n## KB-002: Second\n**source_of_truth:** `x.md`\n"
    df = spark.createDataFrame([("f", text)], "file string, text string")
    got = {r.chunk_id: r for r in retrieval.chunk_sections(df, ["file"], "text").collect()}
    assert set(got) == {"one", "kb-002"}
    assert got["one"].title == "First title" and got["one"].keywords == "a, b" and got["one"].source_of_truth == ""
    assert "## KB-02: bad" in got["one"].text and got["one"].text.startswith("## KB-001")
    assert got["kb-002"].source_of_truth == "x.md"
    assert retrieval.check_chunks(retrieval.chunk_sections(df, ["file"], "text")) == 2
    with pytest.raises(ValueError):
        retrieval.check_chunks(retrieval.chunk_sections(df.union(df), ["file"], "text"))
    with pytest.raises(ValueError):
        retrieval.check_chunks(retrieval.chunk_sections(df.limit(0), ["file"], "text"))


def test_context_text(spark):
    df = spark.createDataFrame([("q", 1, "KB-1", "aa"), ("q", 2, "KB-2", "bb"), ("q", 3, "KB-3", "c" * 50)], "q string, r int, kb string, t string")
    r = retrieval.assemble_context(df, ["q"], [F.col("r")], "kb", "t", "r", budget=25).first()
    assert r.context == "[KB-1]\naa\n\n---\n\n[KB-2]\nbb" and r.n_passages == 2


def test_rollup_has_one_row_per_key(spark):
    rows = [("g", f"p{i:05d}", "n") for i in range(10_050)] + [("h", "p1", None), ("h", "p1", "m"), ("i", None, "z"), (None, "p9", "z")]
    df = spark.createDataFrame(rows, "g string, p string, n string")
    by = {r.g: r for r in agg.rollup_ids(df, "g", "p", ["n"]).collect()}
    assert sorted(by) == ["g", "h", "i"]
    assert by["g"].member_count == 10_050 and by["g"].first_member == "p00000" and by["g"].last_member == "p10049"
    assert by["h"].member_count == 1 and by["h"].n == "m" and by["i"].member_count == 0
    assert agg.member_rows(df, "g", "p").groupBy("g").count().where("g = 'g'").first()[1] == 10_050


def test_mixed_sort(spark):
    df = spark.createDataFrame([(1, "10"), (2, "9"), (3, None), (4, ""), (5, "b"), (6, "A"), (7, " 3 ")], "i int, v string")
    assert [r.i for r in sorting.mixed_sort(df, "v", "i").collect()] == [7, 2, 1, 6, 5, 3, 4]
    assert [r.i for r in sorting.mixed_sort(df, "v", "i", descending=True).collect()] == [5, 6, 1, 2, 7, 3, 4]


def test_sets(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(2,), (3,)], "id int")
    assert sorted(tuple(r) for r in sets.id_diff(a, b, "id").collect()) == [(1, "stale"), (3, "new")]
    assert sorted(r.id for r in sets.upsert(a, b, "id").collect()) == [2, 3]
    assert sets.union_all(spark, [], "id int").columns == ["id"]


def test_clusters_are_numbered_by_centre(spark):
    pts = [(i, float(i % 3) * 10 + (i % 7) * 0.01, 1.0) for i in range(90)]
    df = ml.stored_features(spark.createDataFrame(pts, "id int, x double, y double"), ["x", "y"], ["id"])
    got = {r.id: r.cluster_id for r in ml.cluster(df, 3).select("id", "cluster_id").collect()}
    assert all(got[i] == i % 3 for i in range(90))
    scores = ml.select_k(df, ks=[2, 3, 4])
    assert ml.best_k(scores) == 3


def test_quality(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None), (4, float("nan"))], "rank int, v double")
    with pytest.raises(ValueError, match="lacks columns: x"):
        quality.require_columns(df, ["rank", "x"])
    with pytest.raises(ValueError):
        quality.require_schema(df, ["v", "rank"])
    with pytest.raises(ValueError):
        quality.require_schema(df, ["rank", "v"], {"v": "int"})
    assert {r.check: r.n_bad for r in quality.null_rows(df, ["rank", "v"]).collect()} == {"rank": 0, "v": 2, "any": 2}
    assert quality.rank_gaps(df, "rank").first().contiguous is False
    with pytest.raises(AssertionError):
        quality.assert_clean(quality.violations(df, {"positive": F.col("v") > 0}))
    assert math.isclose(agg.shares(df, "rank").agg(F.sum("percentage")).first()[0], 100.0)


@pytest.mark.parametrize("n", [1, 999, 1000, 1001, 1500])
def test_first_rows_of_large_groups(spark, skewed, n):
    data, df = skewed
    got = {r.id for r in sorting.n_per_group(df, ["k"], [F.col("v").desc(), F.col("id").asc()], n).collect()}
    want = set()
    for k in {r[1] for r in data}:
        want |= {r[0] for r in sorted((r for r in data if r[1] == k), key=lambda r: (-r[2], r[0]))[:n]}
    assert got == want


def test_iqr_fences_are_exact_for_many_rows(spark):
    import math

    rows = [(i, (i * 7919) % 60013 * 1000) for i in range(60000)]
    vals = sorted(v for _, v in rows)
    low, high = (vals[math.ceil(p * len(vals)) - 1] for p in (0.25, 0.75))
    bounds = agg.iqr_bounds(spark.createDataFrame([*rows, (-1, None)], "id int, v bigint").repartition(4), ["v"]).first()
    assert (bounds.v_lower, bounds.v_upper) == (low - 1.5 * (high - low), high + 1.5 * (high - low))


def test_sample_median_is_exact_for_many_rows(spark, many_slices):
    rows = [("hot" if i < 50000 else None, (i * 7919) % 50021) for i in range(50021)] + [("hot", None), ("bare", None)]
    got = {r.s: r for r in agg.sample_qc(spark.createDataFrame([(s, v, v, "c") for s, v in rows], "s string, n int, v int, k string").repartition(4), ["s"], "n", "v", "k", "c").collect()}
    for s in ("hot", None):
        vals = sorted(v for k, v in rows if k == s and v is not None)
        assert got[s].median_level == vals[(len(vals) + 1) // 2 - 1] and got[s].n_class == len(vals) + (s == "hot")
    assert got["bare"].median_level is None and got["bare"].n_class == 1
