"""All phases on small raw files, from reading to the published views."""

import json
import math
import random

import pytest

from provenor.plans import run, views
from provenor.plans.snapshots import snapshots  # noqa: F401
from provenor.sources.tables import read_snapshot, read_table

GENES = [f"G{i:02d}" for i in range(40)]
UP = set(GENES[:6])


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    rnd = random.Random(11)
    root = tmp_path_factory.mktemp("phases")
    hits, header = [], "gene_id\tgene_name\tgene_type\tunstranded\ttpm_unstranded\tfpkm_unstranded\tfpkm_uq_unstranded"
    for s in range(16):
        tumor = s < 9
        d = root / "raw" / "counts" / f"file_id=f{s:02d}"
        d.mkdir(parents=True)
        lines = ["# gene-model: v36", header, "N_unmapped\t\t\t9\t\t\t"]
        for i, g in enumerate(GENES):
            boost = 150 if tumor and g in UP else 0
            # the last sample is an outlier: its library is far larger
            count = rnd.randint(50, 60) * (200 if s == 15 else 1) + boost
            lines.append(f"ENSG{i:011d}.2\t{g}\tprotein_coding\t{count}\t{count / 10 + rnd.random()}\t1.0\t1.0")
        lines.append("ENSG99999999999.1_PAR_Y\tPAR\tprotein_coding\t5\t5\t1\t1")
        lines.append("ENSG88888888888.1\tLNC\tlncRNA\t0\t0\t0\t0")
        (d / "counts.tsv").write_text("\n".join(lines) + "\n")
        hits.append({"file_id": f"f{s:02d}", "file_name": f"n{s}.tsv", "cases": [{"case_id": f"c{s}", "samples": [
            {"sample_id": f"s{s:02d}", "sample_type": "Primary Tumor" if tumor else "Solid Tissue Normal", "tissue_type": None}]}]})
    hits.append({"file_id": "nofile", "file_name": "x", "cases": None})
    (root / "raw" / "index.json").write_text(json.dumps({"data": {"hits": hits}}))
    (root / "raw" / "cases.tsv").write_text("case_id\tsamples.0.sample_id\tsamples.0.sample_type\nc0\ts00\tPrimary Tumor\n")
    links = ["protein1 protein2 combined_score"]
    for i in range(40):
        for j in range(i + 1, 40):
            if rnd.random() < 0.3:
                w = rnd.randint(150, 999)
                links += [f"9606.ENSP{i} 9606.ENSP{j} {w}", f"9606.ENSP{j} 9606.ENSP{i} {w}"]
    (root / "raw" / "links.txt").write_text("\n".join(links) + "\n")
    alias = ["#string_protein_id\talias\tsource"]
    for i, g in enumerate(GENES):
        if g != "G05":
            alias.append(f"9606.ENSP{i}\t{g.lower()}\tEnsembl_HGNC_symbol")
        alias.append(f"9606.ENSP{i}\tENSG{i:011d}\tEnsembl_gene")
    (root / "raw" / "aliases.txt").write_text("\n".join(alias) + "\n")
    samples = [f"GSM{i}" for i in range(12)]
    matrix = ["text", "ID_REF\tDescription\t" + "\t".join(samples)]
    for g in GENES[:4] + GENES[:1]:
        matrix.append(f"{g}\td\t" + "\t".join(f"{rnd.uniform(2, 9):.3f}" for _ in samples))
    (root / "raw" / "matrix.txt").write_text("\r\n".join(matrix) + "\r\n")
    meta = ["!series_table_begin = Clinical_annotations_curated", "Original Study\tCohort\tMergeGroup\tArray"]
    meta += [f"a\tb\tm\t{s.lower()} " for s in samples[:10]] + ["!series_table_end"]
    (root / "raw" / "meta.txt").write_text("\n".join(meta) + "\n")
    b = str(root)
    run.refine_counts(spark, f"{b}/raw/counts/file_id=*/*.tsv", f"{b}/raw/index.json", f"{b}/raw/cases.tsv", f"{b}/refined/counts")
    run.refine_graph(spark, f"{b}/raw/links.txt", f"{b}/raw/aliases.txt", f"{b}/refined/graph")
    run.refine_cohort(spark, f"{b}/raw/matrix.txt", f"{b}/raw/meta.txt", f"{b}/refined/cohort")
    run.analyse(spark, f"{b}/refined/counts", f"{b}/refined/graph", f"{b}/analysis", f"{b}/mart", top_n=4)
    run.validate(spark, f"{b}/refined/cohort", f"{b}/analysis", f"{b}/mart")
    return b


def test_refined_tables(spark, base):
    qc = read_table(spark, f"{base}/refined/counts/quality_check")
    bad = qc.where("is_outlier_library_size").collect()
    assert [r.sample_id for r in bad] == ["s15"]
    assert qc.count() == 16 and qc.where("num_protein_coding_genes = 41 AND abs(pct_zero_genes - 1/42D) < 1e-12").count() == 16
    coding = read_table(spark, f"{base}/refined/counts/counts_clean_protein_coding")
    assert coding.count() == 16 * 40 and "is_par_y" not in coding.columns
    m = {r.file_id: r.has_count_file for r in read_table(spark, f"{base}/refined/counts/file_sample_map").collect()}
    assert len(m) == 17 and m["nofile"] is False and m["f00"] is True
    genes = read_table(spark, f"{base}/refined/graph/nodes_gene")
    assert genes.count() == 40 and genes.where("protein_count = 1").count() == 40
    assert read_table(spark, f"{base}/refined/graph/gene_proteins").count() == 40
    nodes = read_table(spark, f"{base}/refined/graph/nodes_protein")
    both = read_table(spark, f"{base}/refined/graph/edges_protein").where("protein_id_src = '9606.ENSP0'")
    one = nodes.where("protein_id = '9606.ENSP0'").first()
    assert one.degree_protein == both.count()
    assert math.isclose(one.weighted_degree_protein, 2 * both.selectExpr("sum(edge_weight_protein)").first()[0])


def test_ranking(spark, base):
    diff = read_table(spark, f"{base}/analysis/deg_result")
    called = {r.gene_name for r in diff.where("is_deg").collect()}
    assert called == UP
    assert diff.count() == 40
    mapped = read_table(spark, f"{base}/analysis/deg_mapped_proteins")
    assert {r.gene_name for r in mapped.collect()} == called - {"G05"}
    ranked = read_table(spark, f"{base}/analysis/candidate_target_features").orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, len(ranked) + 1))
    assert all(a.final_score >= b.final_score for a, b in zip(ranked, ranked[1:]))


def test_support(spark, base):
    got = {r.gene_name: r for r in read_table(spark, f"{base}/analysis/geo_validation_result").collect()}
    for r in got.values():
        assert r.geo_total_samples == 10
        found = r.gene_name in GENES[:4]
        assert (r.geo_match_status == "Found in GEO cohort") is found
        assert (r.geo_support_score is not None) is found
        if found:
            assert r.geo_coverage_rate == 1.0
            want = 0.2 * r.geo_coverage_rate + 0.5 * r.geo_mean_percentile + 0.3 * r.geo_top_quartile_rate
            assert math.isclose(r.geo_support_score, want)
        else:
            assert r.geo_support_level == "Not Found"
    summary = read_table(spark, f"{base}/analysis/geo_validation_summary")
    assert math.isclose(summary.selectExpr("sum(candidate_percentage)").first()[0], 100.0)


def test_clusters_and_views(spark, base):
    # clustering needs more points than clusters: widen the candidates with copies under other ids
    from pyspark.sql import functions as F

    cand = read_table(spark, f"{base}/analysis/candidate_target_features")
    more = cand.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(9)))).select(
        *[c for c in cand.columns if c not in ("protein_id", "log2FC", "avg_combined_score")],
        F.when(F.col("copy") == 0, F.col("protein_id")).otherwise(F.concat("protein_id", F.lit("#"), "copy")).alias("protein_id"),
        (F.col("log2FC") + F.col("copy") * 0.31).alias("log2FC"), (F.col("avg_combined_score") + (F.col("copy") % 3) * 90).alias("avg_combined_score"),
    ).select(*cand.columns)
    more.write.parquet(f"{base}/analysis2/candidate_target_features")
    for name in ("geo_validation_result", "geo_validation_summary", "geo_supported_top_candidates", "qc_pass_expression", "deg_result", "deg_mapped_proteins"):
        read_table(spark, f"{base}/analysis/{name}").write.parquet(f"{base}/analysis2/{name}")
    run.cluster(spark, f"{base}/analysis2", f"{base}/mart")
    assert read_table(spark, f"{base}/analysis2/ml_k_selection").count() == 5
    points = read_table(spark, f"{base}/analysis2/candidate_clusters")
    summary = read_table(spark, f"{base}/analysis2/ml_cluster_summary")
    assert summary.selectExpr("sum(num_candidates)").first()[0] == points.count() == more.count()
    top = read_table(spark, f"{base}/mart/top_candidate_targets_enriched")
    assert len(top.columns) == 30 and top.count() == min(4, cand.count())

    published = run.publish(spark, f"{base}/refined/counts", f"{base}/refined/graph", f"{base}/analysis2", f"{base}/mart", f"{base}/views")
    assert len(published) == 27
    metrics = {r.metric_name: r.metric_value for r in read_snapshot(spark, f"{base}/views", "overview_summary").collect()}
    assert metrics["GDC samples before QC"] == 16 and metrics["GDC samples after QC"] == 15 and len(metrics) == 11
    assert read_snapshot(spark, f"{base}/views", "deg_heatmap_matrix").count() == read_table(spark, f"{base}/analysis/deg_result").where("is_deg").count()

    best = top.orderBy("rank").first()
    detail = views.target_detail(published["top_candidate_targets_enriched"], best.gene_name.lower()).first()
    assert detail.identity.protein_id == best.protein_id and detail.phase_6_geo.mode == "tumor_cohort_expression_support"
    parts = views.score_breakdown(top, best.protein_id).collect()
    assert math.isclose(sum(r.weighted_score for r in parts), best.final_score, abs_tol=2e-4)
    page = views.targets(top, limit=2, deg_direction="upregulated").collect()
    assert [r["rank"] for r in page] == [1, 2] and page[0].total == top.count()
    nodes, edges = views.network(published["ppi_visualization_nodes"], published["ppi_visualization_edges"], protein_id=best.protein_id)
    assert best.protein_id in {r.protein_id for r in nodes.collect()}
    assert edges.where("edge_weight_protein < 0.4").count() == 0
    assert views.volcano(published["volcano_points"], top).where("is_top_candidate").count() == top.count()
    report = views.ml_report(points, summary, top).collect()
    assert math.isclose(sum(r.population_percentage for r in report), 100.0)
    assert all(r.abs_log2FC["min"] <= r.abs_log2FC["median"] <= r.abs_log2FC["max"] for r in report)
    assert views.ml_scatter(points, top, top_only=True).count() == top.count()
    assert views.unmatched(published["geo_unmatched_candidates"], top).where("geo_match_reason IS NULL").count() == 0
    record = json.loads(views.context_record(published).first().bundle)
    assert len(record["top_targets"]) == top.count() and record["edge_count"] == edges.sparkSession.read.json(f"{base}/views/ppi_visualization_edges").count()
    q = spark.createDataFrame([(1, f"what about {best.gene_name}?"), (2, "nothing")], "qid int, text string")
    named = views.question_context(q, "qid", "text", top, published["network_top_proteins"]).collect()
    assert [(r.qid, r.protein_id) for r in named] == [(1, best.protein_id)]
    worst = top.orderBy("rank").collect()[-1]
    asked = json.loads(views.context_record(published, f"why is {worst.gene_name} there?", best.protein_id).first().bundle)
    assert [r["protein_id"] for r in asked["referenced_rows"]] == [best.protein_id, worst.protein_id] and asked["edge_filter"]


def test_network_rows_come_by_weighted_degree(spark):
    from pyspark.sql import functions as F

    top = spark.createDataFrame([(1, "AAA", "9606.P1", 1.0)], "rank int, gene_name string, protein_id string, weighted_degree_protein double")
    net = spark.createDataFrame(
        [(2, "BBB", "9606.P2", 1.0), (3, "CCC", "9606.P3", 9.0), (1, "AAA", "9606.P1", 1.0), (4, "DDD", None, 5.0)], "rank int, gene_name string, protein_id string, weighted_degree_protein double"
    )
    q = spark.createDataFrame([(1, "AAA BBB CCC and DDD")], "qid int, text string")
    got = views.question_context(q, "qid", "text", top, net).orderBy(F.col("mention_no")).collect()
    assert [r.gene_name for r in got] == ["AAA", "CCC", "DDD", "BBB"]


def test_knowledge_index(spark, tmp_path):
    from pyspark.sql import functions as F

    from provenor.plans import knowledge

    (tmp_path / "kb.md").write_text("# top\n## KB-001: One\n**chunk_id:** `a`\n**keywords:** `k`\ntext\n## KB-002: Two\nmore\n")
    chunks = knowledge.checked_chunks(spark, str(tmp_path / "kb.md"))
    got = {r.id: r for r in chunks.collect()}
    assert set(got) == {"a", "kb-002"} and got["a"].title == "KB-001: One" and got["a"].metadata["keywords"] == "k"
    assert got["kb-002"].embedding_text == "title: KB-002: Two | text: ## KB-002: Two\nmore"
    vec = F.array(F.lit(1.0), F.lit(0.5))
    index = spark.createDataFrame([("a", "old"), ("gone", "x")], "id string, text string").select("id", "text", F.create_map(F.lit("k"), F.lit("v")).alias("metadata"), vec.alias("embedding"))
    assert sorted(tuple(r) for r in knowledge.index_changes(index, chunks).collect()) == [("gone", "stale"), ("kb-002", "new")]
    out = str(tmp_path / "index")
    knowledge.refresh_index(index, chunks.withColumn("embedding", vec), out)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "kb-002"]
