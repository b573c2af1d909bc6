"""Name-to-id mapping: alias table to entity map, nodes, and mapped evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenor import constants as K
from provenor.functions import extract_id, norm_key
from provenor.operators.aggregates import member_rows, rollup_ids
from provenor.operators.graph import degrees
from provenor.operators.joins import assemble, attach_ends, map_entities
from provenor.operators.sets import all_nodes
from provenor.operators.shape import confidence
from provenor.operators.windows import canonical_edges


def entity_map(
    aliases: DataFrame, key: str = "protein_id", alias: str = "alias_value", source: str = "source",
    id_source: str = K.ALIAS_ID_SOURCE, name_source: str = K.ALIAS_NAME_SOURCE, id_pattern: str = K.GENE_PREFIX,
    id_out: str = "gene_id", name_out: str = "gene_name", norm_out: str = "gene_name_norm", confidence_out: str = "gene_confidence",
) -> DataFrame:
    """One row per key with its smallest id and name and how many of them exist.

    Both picks are conditional minima of one aggregation, so no join is needed.
    """
    src = F.lower(F.trim(source))
    used = aliases.where(src.isin(id_source, name_source))
    is_id = (src == id_source) & F.col(alias).rlike(id_pattern)
    picked = used.groupBy(key).agg(
        F.min(F.when(is_id, F.col(alias))).alias(id_out),
        F.min(F.when(src == name_source, F.col(alias))).alias(name_out),
    )
    return picked.withColumns({
        norm_out: norm_key(name_out, strip_inner=True),
        confidence_out: confidence(F.col(id_out), F.col(name_out)),
    })


def gene_map(aliases: DataFrame) -> DataFrame:
    """Protein to gene map from parsed alias lines."""
    return entity_map(aliases).withColumn("ensp_id", extract_id("protein_id", K.PROTEIN_ACCESSION)).select(
        "protein_id", "ensp_id", "gene_id", "gene_name", "gene_name_norm", "gene_confidence"
    )


def protein_edges(links: DataFrame) -> DataFrame:
    """Edges with accessions and a weight of 0..1 from parsed link lines."""
    return links.select(
        F.col("src").alias("protein_id_src"), F.col("dst").alias("protein_id_dst"),
        extract_id("src", K.PROTEIN_ACCESSION).alias("ensp_id_src"), extract_id("dst", K.PROTEIN_ACCESSION).alias("ensp_id_dst"),
        F.col("score").alias("combined_score_protein"), (F.col("score") / K.EDGE_SCALE).alias("edge_weight_protein"),
    )


def gene_edges(edges: DataFrame, genes: DataFrame, parts: int = 0) -> DataFrame:
    """One undirected edge per gene pair with its best protein edge; ends without a gene have none, so they go before they are dealt."""
    joined = attach_ends(
        edges, genes.select("protein_id", "gene_id", "gene_name"), "protein_id", "protein_id_src", "protein_id_dst", how="inner", parts=parts
    )
    rolled = canonical_edges(
        joined, "gene_id_src", "gene_id_dst", [("gene_name_src", "gene_name_dst"), ("ensp_id_src", "ensp_id_dst")],
        "combined_score_protein", "edge_weight_protein", ("ensp_id_src", "ensp_id_dst"),
    )
    return rolled.select(
        "gene_name_src", "gene_name_dst", "gene_id_src", "gene_id_dst",
        F.col("ensp_id_src").alias("best_ensp_id_src"), F.col("ensp_id_dst").alias("best_ensp_id_dst"),
        F.col("max_combined_score_protein").cast("double").alias("max_combined_score_gene"),
        F.col("max_edge_weight_protein").cast("double").alias("max_edge_weight_gene"),
        F.col("edge_count").alias("protein_edge_count"),
    )


def gene_nodes(genes: DataFrame, edges: DataFrame) -> DataFrame:
    """Genes with degree, weighted degree and the number of their proteins, one row per gene."""
    degree = degrees(edges, "gene_id_src", "gene_id_dst", "max_edge_weight_gene", "gene_id")
    rolled = rollup_ids(genes, "gene_id", "protein_id", ["gene_name", "gene_name_norm"])
    return assemble(rolled, "gene_id", [degree], {"degree": 0, "weighted_degree": 0.0}).select(
        "gene_name", "gene_name_norm", "gene_id", F.col("degree").alias("degree_gene"),
        F.col("weighted_degree").alias("weighted_degree_gene"), F.col("member_count").alias("protein_count"),
    )


def gene_proteins(genes: DataFrame) -> DataFrame:
    """The proteins of each gene as rows."""
    return member_rows(genes, "gene_id", "protein_id")


def protein_nodes(genes: DataFrame, edges: DataFrame, parts: int = 0) -> DataFrame:
    """Every protein of the map or of an edge, with degree and weighted degree."""
    nodes = all_nodes(edges, "protein_id_src", "protein_id_dst", genes, "protein_id")
    degree = degrees(edges, "protein_id_src", "protein_id_dst", "edge_weight_protein", "protein_id", parts=parts)
    named = genes.select("protein_id", F.col("ensp_id").alias("__ensp"), "gene_id", "gene_name", "gene_name_norm")
    return assemble(nodes, "protein_id", [named, degree], {"degree": 0, "weighted_degree": 0.0}).select(
        "protein_id", F.coalesce("__ensp", extract_id("protein_id", K.PROTEIN_ACCESSION)).alias("ensp_id"),
        F.lit(None).cast("string").alias("protein_name"), "gene_id", "gene_name", "gene_name_norm",
        F.col("degree").alias("degree_protein"), F.col("weighted_degree").alias("weighted_degree_protein"),
    )


def mapped_evidence(diff: DataFrame, genes: DataFrame) -> DataFrame:
    """Different genes with the proteins of the same normalised name."""
    left = diff.where(F.coalesce("is_deg", F.lit(False))).select("gene_id_base", "gene_name", "log2FC", "p_value", "deg_direction")
    right = genes.where(F.col("protein_id").isNotNull()).select(
        "protein_id", "ensp_id", "gene_confidence", F.col("gene_name_norm").alias("__norm"), F.col("gene_name").alias("__raw")
    )
    return map_entities(left, right, "gene_name", ["__norm", "__raw"]).select(
        "gene_id_base", "gene_name", "protein_id", "ensp_id", "gene_confidence", "log2FC", "p_value", "deg_direction"
    )
