"""The phases as jobs: each reads stored tables and writes its own, so any of them can be repeated alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenor import constants as K
from provenor.operators import quality, stats
from provenor.plans import clusters, evidence, mapping, refine, snapshots, support
from provenor.session import job, tasks_for
from provenor.sinks.tables import write_observed, write_sized, write_table
from provenor.sources import files
from provenor.sources.tables import read_table


def _store(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), sized: bool = False) -> DataFrame:
    (write_sized(df, path, partition_by=partition_by) if sized else write_table(df, path, partition_by))
    return read_table(df.sparkSession, path)


@job
def refine_counts(spark: SparkSession, counts_path: str, index_path: str, cases_path: str, out: str) -> None:
    """Sample map, clean counts by group, protein-coding counts and sample QC."""
    raw = files.read_counts(spark, counts_path)
    samples = refine.case_samples(files.read_tsv(spark, cases_path))
    file_map = _store(
        refine.file_sample_map(files.read_nested_index(spark, index_path), samples, files.file_inventory(spark, counts_path)), f"{out}/file_sample_map"
    )
    quality.assert_none(quality.dup_keys(file_map, ["file_id"]), "repeated file_id in file_sample_map")
    counts = _store(refine.counts_clean(raw, file_map), f"{out}/counts_clean", ("sample_group",), sized=True)
    quality.assert_none(quality.orphans(counts, file_map, "file_id"), "file_id of counts_clean without a file")
    coding = _store(refine.protein_coding(counts), f"{out}/counts_clean_protein_coding", ("sample_group",), sized=True)
    quality.assert_clean(quality.violations(coding, {
        "class": F.col("gene_type") == K.CODING_CLASS, "no flagged gene": ~F.col("gene_id").endswith(K.PAR_Y_SUFFIX),
    }), "counts_clean_protein_coding")
    qc = _store(refine.quality_check(counts), f"{out}/quality_check")
    quality.assert_none(quality.dup_keys(qc, ["file_id", "sample_id"]), "repeated file and sample in quality_check")
    quality.assert_clean(quality.out_of_range(qc, {"pct_zero_genes": (0.0, 1.0)}, null_is_bad=True), "quality_check")


@job
def refine_graph(spark: SparkSession, links_path: str, aliases_path: str, out: str) -> None:
    """Entity map, protein and gene edges, protein and gene nodes."""
    genes = _store(mapping.gene_map(files.read_alias_text(spark, aliases_path)), f"{out}/gene_map")
    edges = _store(mapping.protein_edges(files.read_edge_text(spark, links_path)), f"{out}/edges_protein", sized=True)
    quality.assert_clean(
        quality.out_of_range(edges, {"combined_score_protein": (0, 1000), "edge_weight_protein": (0.0, 1.0)}), "edges_protein"
    )
    n_edges = edges.count()
    gene_edges = _store(mapping.gene_edges(edges, genes, tasks_for(spark, n_edges)), f"{out}/edges_gene", sized=True)
    quality.assert_clean(quality.violations(gene_edges, {"ordered pair": F.col("gene_id_src") < F.col("gene_id_dst")}), "edges_gene")
    gene_nodes = _store(mapping.gene_nodes(genes, gene_edges), f"{out}/nodes_gene")
    _store(mapping.gene_proteins(genes), f"{out}/gene_proteins")
    quality.assert_none(quality.dup_keys(gene_nodes, ["gene_id"]), "repeated gene_id in nodes_gene")
    nodes = _store(mapping.protein_nodes(genes, edges, tasks_for(spark, 2 * n_edges)), f"{out}/nodes_protein")
    quality.assert_none(quality.dup_keys(genes, ["protein_id"]), "repeated protein_id in gene_map")
    quality.assert_none(quality.dup_keys(nodes, ["protein_id"]), "repeated protein_id in nodes_protein")
    quality.assert_clean(quality.out_of_range(gene_nodes, {"degree_gene": (0, None), "weighted_degree_gene": (0, None)}), "nodes_gene")
    quality.assert_clean(quality.out_of_range(nodes, {"degree_protein": (0, None), "weighted_degree_protein": (0, None)}), "nodes_protein")


@job
def refine_cohort(spark: SparkSession, expression_path: str, metadata_path: str, out: str) -> None:
    """Cohort matrix and annotations with a table of run metrics."""
    expr = refine.cohort_expression(spark, expression_path)
    rows = F.count(F.lit(1))
    m = write_observed(expr, f"{out}/expression", {"expression_rows": (rows, "rows after cleaning"), "expression_columns": (F.max(F.lit(len(expr.columns))), "columns after cleaning")})
    meta = write_observed(refine.cohort_metadata(spark, metadata_path), f"{out}/metadata", {"metadata_rows": (rows, "rows after cleaning")})
    _store(m.unionByName(meta), f"{out}/run_metrics")


@job
def analyse(spark: SparkSession, counts: str, graph: str, out: str, mart: str, top_n: int = K.TOP_N) -> None:
    """QC-passed expression, difference test, mapping, network features and ranked candidates."""
    qc = read_table(spark, f"{counts}/quality_check")
    expr = _store(evidence.qc_pass_expression(read_table(spark, f"{counts}/counts_clean_protein_coding"), qc), f"{out}/qc_pass_expression", sized=True)
    failed = qc.where("is_outlier_library_size OR is_outlier_detected_genes")
    quality.assert_none(quality.leaks(expr, failed, ["sample_id"]).where("n_leaked > 0"), "excluded samples in qc_pass_expression")
    stats.check_groups(expr.withColumn("sample_group", F.lower(F.trim("sample_group"))), "sample_group", "sample_id", "tumor", "normal")
    diff = _store(evidence.difference(expr), f"{out}/deg_result")
    quality.assert_clean(quality.out_of_range(diff, {"p_value": (0.0, 1.0)}), "deg_result")
    mapped = _store(mapping.mapped_evidence(diff, read_table(spark, f"{graph}/gene_map")), f"{out}/deg_mapped_proteins")
    edges = read_table(spark, f"{graph}/edges_protein")
    feats = _store(
        evidence.network_features(mapped, edges, read_table(spark, f"{graph}/nodes_protein"), tasks_for(spark, 2 * edges.count())),
        f"{out}/protein_network_features",
    )
    ids = mapped.select("protein_id").distinct()
    quality.assert_none(quality.row_counts({"features": (ids, feats)}).where("NOT preserved"), "rows of protein_network_features")
    quality.assert_clean(quality.violations(feats, {
        "high edges within all edges": F.col("num_high_confidence_edges") <= F.col("num_interactions_in_deg_network"),
    }), "protein_network_features")
    ranked = _store(evidence.candidate_features(mapped, feats), f"{out}/candidate_target_features")
    quality.assert_clean(quality.out_of_range(ranked, {"final_score": (0.0, 1.0)}, null_is_bad=True), "candidate_target_features")
    quality.assert_none(quality.rank_gaps(ranked, "rank").where("n_rows > 0 AND NOT contiguous"), "ranks of candidate_target_features")
    _store(ranked.where(F.col("rank") <= top_n), f"{mart}/top_candidate_targets")


@job
def validate(spark: SparkSession, cohort: str, out: str, mart: str) -> None:
    """Cohort support of the top candidates, its summary and the support ranking."""
    top = read_table(spark, f"{mart}/top_candidate_targets")
    result = _store(
        support.cohort_support(top, read_table(spark, f"{cohort}/expression"), read_table(spark, f"{cohort}/metadata")), f"{out}/geo_validation_result"
    )
    missing = F.col("geo_support_level") == K.SUPPORT_NOT_FOUND
    quality.assert_clean(quality.violations(result, {"no score exactly where not found": missing == F.col("geo_support_score").isNull()}), "geo_validation_result")
    summary = _store(support.support_summary(result), f"{out}/geo_validation_summary")
    totals = quality.reconcile_totals(summary, "candidate_count", "candidate_percentage", top)
    quality.assert_none(totals.where("n_expected > 0 AND NOT (counts_agree AND percent_agrees)"), "totals of geo_validation_summary")
    _store(support.supported_top_candidates(result, stored=True), f"{out}/geo_supported_top_candidates")


@job
def cluster(spark: SparkSession, out: str, mart: str) -> None:
    """Clusters of all candidates and the enriched ranking."""
    features = _store(clusters.ml_features(read_table(spark, f"{out}/candidate_target_features")), f"{out}/ml_candidate_features")
    quality.assert_clean(quality.null_rows(features, ["protein_id", *clusters.FEATURES, "final_score"]), "ml_candidate_features")
    scores, points, summary = clusters.cluster_candidates(features)
    _store(scores, f"{out}/ml_k_selection")
    points = _store(points, f"{out}/candidate_clusters")
    _store(summary, f"{out}/ml_cluster_summary")
    quality.assert_none(quality.row_counts({"clusters": (features, points)}).where("NOT preserved"), "rows of candidate_clusters")
    top, result = read_table(spark, f"{mart}/top_candidate_targets"), read_table(spark, f"{out}/geo_validation_result")
    _store(clusters.enriched_targets(top, result, points), f"{mart}/top_candidate_targets_enriched")


def publish(spark: SparkSession, counts: str, graph: str, out: str, mart: str, target: str) -> dict[str, DataFrame]:
    """All published views as JSON datasets; the views returned still read what the job stored."""
    def t(path: str) -> DataFrame:
        return read_table(spark, path)

    views = snapshots.snapshots({
        "qc": t(f"{counts}/quality_check"), "expr": t(f"{out}/qc_pass_expression"), "deg": t(f"{out}/deg_result"),
        "mapped": t(f"{out}/deg_mapped_proteins"), "candidate_features": t(f"{out}/candidate_target_features"),
        "top_enriched": t(f"{mart}/top_candidate_targets_enriched"), "geo_result": t(f"{out}/geo_validation_result"),
        "geo_summary": t(f"{out}/geo_validation_summary"), "geo_supported": t(f"{out}/geo_supported_top_candidates"),
        "candidate_clusters": t(f"{out}/candidate_clusters"), "ml_k": t(f"{out}/ml_k_selection"),
        "ml_summary": t(f"{out}/ml_cluster_summary"), "edges": t(f"{graph}/edges_protein"),
    })
    snapshots.write_snapshots(views, target)
    return views
