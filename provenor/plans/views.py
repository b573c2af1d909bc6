"""Interactive views over the published tables: search, detail, network, plots, cluster report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenor import constants as K
from provenor.operators import aggregates as agg
from provenor.operators import filters, graph, joins, retrieval, shape
from provenor.operators.sorting import arg_max

TARGET_IDS = ["protein_id", "gene_name", "ensp_id"]
FEATURES = ["abs_log2FC", "weighted_degree_protein", "avg_combined_score", "num_interactions_in_deg_network"]


def rank_first() -> list[Column]:
    return [F.col("rank").asc_nulls_last(), F.col("protein_id").asc()]


def with_meaning(df: DataFrame) -> DataFrame:
    """Adds the meaning of the cluster id."""
    known = F.col("cluster_id").isNotNull()
    other = F.when(known, F.concat(F.lit("Cluster "), F.col("cluster_id"))).otherwise(K.CLUSTER_MEANING_UNKNOWN)
    return joins.attach_label(df, K.CLUSTER_MEANINGS, "cluster_id", "cluster_interpretation", other)


def targets(
    top: DataFrame, limit: int = 20, offset: int = 0, search: str | None = None, cluster_id: int | None = None,
    candidate_group: str | None = None, geo_support_level: str | None = None, geo_validation_status: str | None = None,
    deg_direction: str | None = None, min_final_score: float | None = None,
) -> DataFrame:
    """One page of candidates with the total of the filter; the validation status is another name of the level."""
    page = filters.search_targets(
        top, "rank", limit, offset, tie="protein_id", search=search, search_cols=("gene_name", "protein_id", "ensp_id"),
        equals={"geo_support_level": geo_support_level or geo_validation_status, "deg_direction": deg_direction},
        contains={"candidate_group": candidate_group},
        cluster=None if cluster_id is None else ("cluster_id", cluster_id),
        min_score=None if min_final_score is None else ("final_score", min_final_score),
    )
    return with_meaning(page)


def find_target(top: DataFrame, token: str) -> DataFrame:
    return filters.lookup(top, token, TARGET_IDS, rank_first())


def score_breakdown(top: DataFrame, token: str) -> DataFrame:
    """Component rows of one candidate's score."""
    weights = {name: (column, K.RANK_WEIGHTS[column]) for name, column in K.COMPONENT_NAMES.items()}
    return shape.explode_components(find_target(top, token), ["protein_id", "gene_name", "final_score"], weights)


def target_detail(top: DataFrame, token: str) -> DataFrame:
    """One candidate as nested sections; columns the table lacks are null."""
    row = with_meaning(find_target(top, token))

    def has(c: str) -> Column:
        return F.col(c) if c in row.columns else F.lit(None).cast("double")

    def plain(*names: str) -> dict[str, Column]:
        return {n: has(n) for n in names}

    return shape.nest(row, {
        "identity": plain("gene_name", "protein_id", "ensp_id", "rank"),
        "phase_2_deg": plain("log2FC", "p_value", "deg_direction"),
        "phase_3_mapping": plain("gene_confidence"),
        "phase_4_ppi": plain("degree_protein", "weighted_degree_protein", "num_interactions_in_deg_network", "avg_combined_score", "max_combined_score"),
        "phase_5_scoring": plain("expression_score", "protein_network_score", "string_confidence_score", "final_score"),
        "phase_6_geo": {
            "mode": F.coalesce(has("geo_validation_mode").cast("string"), F.lit(K.SUPPORT_MODE)),
            "match_status": has("geo_match_status"), "coverage_rate": has("geo_coverage_rate"), "mean_expression": has("geo_mean_expression"),
            "median_expression": has("geo_median_expression"), "mean_percentile": has("geo_mean_percentile"),
            "top_quartile_rate": has("geo_top_quartile_rate"), "support_score": has("geo_support_score"), "support_level": has("geo_support_level"),
        },
        "phase_7_ml": {
            "cluster_id": has("cluster_id"), "cluster_interpretation": has("cluster_interpretation"), "candidate_group_source": has("candidate_group"),
        },
    })


def network(
    nodes: DataFrame, edges: DataFrame, top_n: int = 50, min_edge_score: float = K.EDGE_MIN_WEIGHT, cluster_id: int | None = None,
    deg_direction: str | None = None, geo_support_level: str | None = None, protein_id: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the network view; ``protein_id`` is the id of the centre."""
    keep = filters.candidate_filter(
        equals={"deg_direction": deg_direction, "geo_support_level": geo_support_level},
        cluster=None if cluster_id is None else ("cluster_id", cluster_id),
    )
    shown, among = graph.ego_network(
        nodes, edges, "protein_id", protein_id, "protein_id_src", "protein_id_dst", "edge_weight_protein", "rank", top_n, keep, min_edge_score
    )
    return with_meaning(shown), among


def volcano(points: DataFrame, top: DataFrame, max_points: int | None = None, highlight_top_n: int = 20) -> DataFrame:
    """All points with the rank of their candidate; a page of ``max_points`` has ranked points first, then gene ids."""
    marked = joins.highlight(points, top, "gene_name", "rank", highlight_top_n, "is_top_candidate")
    return marked if max_points is None else marked.orderBy(F.col("rank").asc_nulls_last(), "gene_id_base", "gene_name").limit(max_points)


def unmatched(rows: DataFrame, top: DataFrame) -> DataFrame:
    """Unmatched candidates with protein id and reason filled in."""
    return joins.backfill(rows, top, "gene_name", "protein_id", "geo_match_reason")


def ml_scatter(points: DataFrame, top: DataFrame, limit: int | None = None, cluster_id: int | None = None, top_only: bool = False) -> DataFrame:
    rows = points if cluster_id is None else points.where(F.col("cluster_id") == cluster_id)
    if top_only:
        rows = joins.keep_members(rows, top.orderBy(*rank_first()).limit(K.TOP_N), ["protein_id"])
    return with_meaning(rows if limit is None else rows.orderBy("protein_id").limit(limit))


def ml_report(points: DataFrame, summary: DataFrame, top: DataFrame, n: int = K.TOP_N) -> DataFrame:
    """Cluster summary with shares, capture of the top list, leading genes and exact feature ranges."""
    ranked = top.orderBy(*rank_first()).limit(n)
    shares = agg.explain_clusters(points, ranked, "cluster_id", "rank", "gene_name")
    ranges = agg.feature_ranges(points.where(F.col("cluster_id").isNotNull()), ["cluster_id"], FEATURES)
    wide = ranges.groupBy("cluster_id").pivot("feature", FEATURES).agg(F.first(F.struct("min", "median", "max")))
    return with_meaning(summary).join(shares, "cluster_id", "left").join(wide, "cluster_id", "left")


def best_k(scores: DataFrame) -> DataFrame:
    return arg_max(scores, "silhouette_score", "k")


def question_context(questions: DataFrame, question_id: str, text: str, top: DataFrame, network_rows: DataFrame) -> DataFrame:
    """Candidates named in each question: those of ``top`` by rank, then others of ``network_rows`` by weighted degree.

    A row without protein id is known by its gene name.
    """
    own = F.coalesce("protein_id", "gene_name")
    listed = shape.select_existing(top, K.CONTEXT_TARGET_FIELDS + ["gene_id_base"]).withColumn("__id", own)
    extra = network_rows.withColumn("__id", own).join(listed.select("__id"), "__id", "left_anti")
    rows = listed.withColumn("__part", F.lit(0)).unionByName(
        shape.select_existing(extra, listed.columns).withColumn("__part", F.lit(1)), allowMissingColumns=True
    )
    degree = F.when(F.col("__part") == 1, F.col("weighted_degree_protein"))
    order = [F.col("__part").asc(), degree.desc_nulls_last(), F.col("rank").asc_nulls_last()]
    named = [c for c in ("gene_name", "protein_id", "ensp_id", "gene_id_base") if c in rows.columns]
    return joins.entity_mentions(questions, question_id, text, rows, named, "__id", order).drop("__part", "__id")


def referenced_rows(top: DataFrame, network_rows: DataFrame, question: str = "", target: str = "", limit: int = K.MENTION_LIMIT) -> DataFrame:
    """The selected target first, then the candidates that the question names; ``place`` numbers them."""
    asked = top.sparkSession.createDataFrame([(0, question)], "__question int, __text string")
    named = question_context(asked, "__question", "__text", top, network_rows).withColumnRenamed("mention_no", "place")
    named = shape.select_existing(named, [*K.CONTEXT_TARGET_FIELDS, "place"])
    if target:
        chosen = shape.select_existing(find_target(top, target), K.CONTEXT_TARGET_FIELDS)
        others = named.join(chosen.select(F.col("protein_id").alias("__chosen")), F.col("protein_id").eqNullSafe(F.col("__chosen")), "left_anti")
        named = others.unionByName(chosen.withColumn("place", F.lit(0)), allowMissingColumns=True)
    return named.orderBy("place").limit(limit)


def context_record(views: dict[str, DataFrame], question: str = "", target: str = "") -> DataFrame:
    """The structured context as one JSON record of bounded lists from the published views.

    Rows named in the question and the selected target are listed apart.
    """
    top, net, edges = views["top_candidate_targets_enriched"], views["network_top_proteins"], views["ppi_visualization_edges"]
    return retrieval.context_bundle({
        "overview_metrics": (views["overview_summary"], [F.col("metric_no")], None),
        "deg_summary": (views["deg_summary"], [F.col("deg_direction")], None),
        "mapping_summary": (views["gene_protein_mapping_summary"], [F.col("mapping_status")], None),
        "geo_validation_summary": (views["geo_validation_summary"], [F.col("geo_support_level")], None),
        "ml_cluster_summary": (views["ml_cluster_summary"], [F.col("cluster_id")], None),
        "edge_examples": (
            edges.select("gene_name_src", "gene_name_dst", "combined_score_protein", "edge_weight_protein"),
            [F.col("combined_score_protein").desc(), F.col("gene_name_src"), F.col("gene_name_dst")], 5,
        ),
        "edge_filter": (edges.sparkSession.createDataFrame([(K.EDGE_FILTER,)], "edge_filter string"), [F.col("edge_filter")], None),
        "top_targets": (shape.select_existing(top, K.CONTEXT_TARGET_FIELDS), [F.col("rank")], 100),
        "top_network": (
            shape.select_existing(net, K.CONTEXT_NETWORK_FIELDS), [F.col("weighted_degree_protein").desc(), F.col("rank")], 25,
        ),
        "top_effects": (views["top_deg_genes"], [F.col("abs_log2FC").desc(), F.col("gene_name")], 20),
        "referenced_rows": (referenced_rows(top, net, question, target), [F.col("place")], K.MENTION_LIMIT),
    }, {"edge_count": edges})
