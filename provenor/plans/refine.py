"""From raw files to refined tables: sample map, clean counts, sample QC, cohort tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenor import constants as K
from provenor.functions import id_parts, label_group
from provenor.operators.aggregates import collapse, iqr_flags, sample_qc
from provenor.operators.filters import filter_class, keep_matching
from provenor.operators.joins import attach_dim, enrich_left, reconcile
from provenor.operators.quality import require_columns
from provenor.operators.shape import drop_rename, wide_groups_to_long
from provenor.sources.files import read_between, read_from_header

QC_KEYS = ["file_id", "case_id", "sample_id", "sample_type", "sample_group"]


def case_samples(cases: DataFrame) -> DataFrame:
    """Wide case table to one row per case and sample, with the group label."""
    long = wide_groups_to_long(cases, "case_id", ["sample_id", "sample_type", "tissue_type"])
    labelled = long.withColumn("sample_group", label_group("sample_type", "tissue_type"))
    return labelled.groupBy("case_id", "sample_id").agg(*[F.min(c).alias(c) for c in ("sample_type", "tissue_type", "sample_group")])


def file_sample_map(index: DataFrame, samples: DataFrame, inventory: DataFrame) -> DataFrame:
    """One row per file with its sample, and whether its count file was found."""
    dim = samples.select("case_id", "sample_id", F.col("sample_type").alias("__type"), F.col("sample_group").alias("__group"))
    known = enrich_left(
        index.select("file_id", "file_name", "case_id", "sample_id", "sample_type", "sample_group"), dim, ["case_id", "sample_id"],
        {"sample_type": ["sample_type", "__type"], "sample_group": ["sample_group", "__group"]},
    )
    rows = reconcile(known, inventory.select("file_id", "count_file_name"), "file_id", "has_count_file")
    named = rows.withColumns({
        "file_name": F.coalesce("file_name", "count_file_name"), "sample_group": F.coalesce("sample_group", F.lit(K.GROUP_DEFAULT)),
    })
    one = collapse(named, "file_id", flags=["has_count_file"], skip=["count_file_name"])
    return one.select("file_id", "file_name", "case_id", "sample_id", "sample_type", "sample_group", "has_count_file")


def counts_clean(counts: DataFrame, files: DataFrame, salts: int = 0) -> DataFrame:
    """Gene rows of all count files with typed values and their sample."""
    flag, base = id_parts("gene_id")
    genes = keep_matching(counts, "gene_id", K.GENE_PREFIX).select(
        "file_id", "gene_id", base.alias("gene_id_base"), flag.alias("is_par_y"), "gene_name", "gene_type",
        F.col("unstranded").try_cast("bigint").alias("raw_count"), F.col("tpm_unstranded").try_cast("double").alias("tpm"),
        F.col("fpkm_unstranded").try_cast("double").alias("fpkm"), F.col("fpkm_uq_unstranded").try_cast("double").alias("fpkm_uq"),
    )
    dim = files.select("file_id", "case_id", "sample_id", "sample_type", "sample_group")
    return attach_dim(genes, dim, ["file_id"], salts).select(*K.COUNT_COLUMNS)


def protein_coding(counts: DataFrame) -> DataFrame:
    return filter_class(counts, "gene_type", K.CODING_CLASS, "is_par_y")


def quality_check(counts: DataFrame) -> DataFrame:
    """Sample QC metrics with outlier flags."""
    metrics = sample_qc(counts, QC_KEYS, "raw_count", "tpm", "gene_type", K.CODING_CLASS).select(
        *QC_KEYS, F.col("total_count").alias("total_raw_count"), F.col("n_detected").alias("num_detected_genes_raw_gt_0"),
        F.col("n_above_level").alias("num_detected_genes_tpm_gt_1"), F.col("median_level").alias("median_tpm"),
        F.col("zero_share").alias("pct_zero_genes"), F.col("n_class").alias("num_protein_coding_genes"),
    )
    return iqr_flags(metrics, {
        "total_raw_count": "is_outlier_library_size", "num_detected_genes_raw_gt_0": "is_outlier_detected_genes",
    })


def cohort_expression(spark: SparkSession, path: str) -> DataFrame:
    """Wide matrix: gene_name and one text column per sample, names as in the file."""
    raw = read_from_header(spark, path)
    require_columns(raw, ["ID_REF", "Description"], "expression")
    return drop_rename(raw, ["Description"], {"ID_REF": "gene_name"})


def cohort_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Sample annotations without the dropped columns, other names unchanged."""
    raw = read_between(spark, path)
    out = drop_rename(raw, K.METADATA_DROPPED, {})
    require_columns(out, ["MergeGroup"], "metadata")
    return out
