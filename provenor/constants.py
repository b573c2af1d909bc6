"""Labels, thresholds, weights and patterns that results depend on."""

# --- fixed values: sample groups (tested in this order, first hit wins) ---
GROUP_RULES = [
    ("normal", "normal"),
    ("tumor", "tumou?r|tumor|recurrent|metastatic|primary"),
]
GROUP_DEFAULT = "other"

# --- fixed values: identifiers ---
GENE_PREFIX = "^ENSG"
PAR_Y_SUFFIX = "_PAR_Y"
VERSION_SUFFIX = r"\.[0-9]+$"
PROTEIN_ACCESSION = r"(ENSP[0-9]+(?:\.[0-9]+)?)"
LOOSE_ID_PREFIX = "9606."
CODING_CLASS = "protein_coding"
LINK_HEADERS = ["protein1", "protein_id_src", "#protein1"]
ALIAS_HEADERS = ["string_protein_id", "protein_id", "#string_protein_id"]
ALIAS_ID_SOURCE = "ensembl_gene"
ALIAS_NAME_SOURCE = "ensembl_hgnc_symbol"

# --- fixed values: sectioned cohort files ---
EXPRESSION_HEADER_PREFIX = "ID_REF\tDescription\t"
METADATA_BEGIN = "!series_table_begin = Clinical_annotations_curated"
METADATA_END = "!series_table_end"
METADATA_DROPPED = ["Original Study", "Cohort"]

# --- fixed values: thresholds ---
IQR_FACTOR = 1.5
QUANTILE_ACCURACY = 10000
MIN_EFFECT = 1.0
MAX_P = 0.05
EDGE_SCALE = 1000.0
EDGE_MIN_WEIGHT = 0.4
EDGE_HIGH_WEIGHT = 0.7
TOP_N = 100
TOP_QUARTILE = 0.75
NEG_LOG_CAP = 300.0
NEG_LOG_PLOT_CAP = 60.0
K_RANGE = (2, 6)
ML_SEED = 42

# --- fixed values: score weights ---
RANK_WEIGHTS = {"expression_score": 0.5, "protein_network_score": 0.3, "string_confidence_score": 0.2}
SUPPORT_WEIGHTS = {"geo_coverage_rate": 0.2, "geo_mean_percentile": 0.5, "geo_top_quartile_rate": 0.3}

# --- fixed values: labels ---
SUPPORT_NOT_FOUND = "Not Found"
SUPPORT_FOUND = "Found in GEO cohort"
SUPPORT_BANDS = [("Strong GEO support", 0.75), ("Moderate GEO support", 0.50)]
SUPPORT_FLOOR = "Limited GEO support"
SUPPORT_LEVELS = ["Strong GEO support", "Moderate GEO support", "Limited GEO support", "Not Found"]
SUPPORT_MODE = "tumor_cohort_expression_support"
DIRECTION_UP = "Upregulated"
DIRECTION_DOWN = "Downregulated"
DIRECTION_NONE = "No change"
NOT_SIGNIFICANT = "Not significant"
EXCLUDED_BOTH = "Both library size and detected genes outlier"
EXCLUDED_LIBRARY = "Library size outlier"
EXCLUDED_DETECTED = "Detected genes outlier"
EXCLUDED_OTHER = "Other QC exclusion"
CLUSTER_BOTH = "High expression + high network"
CLUSTER_EXPRESSION = "Expression-driven"
CLUSTER_NETWORK = "Network-driven"
CLUSTER_LOW = "Lower priority"
MAPPED_LABEL = "Mapped to STRING protein"
UNMAPPED_LABEL = "Not mapped"
UNMAPPED_REASON = "No matching STRING protein_id in refined STRING gene_map for this DEG."
UNMATCHED_REASON = (
    "No matching GEO tumor-cohort expression entry for this candidate gene in the support mart."
)

# --- fixed values: histogram edges ---
LIBRARY_SIZE_EDGES = [0, 25_000_000, 50_000_000, 75_000_000, 100_000_000, 150_000_000, 250_000_000]
ZERO_RATE_EDGES = [0.0, 0.2, 0.3, 0.4, 0.5, 0.7, 1.0]
EDGE_WEIGHT_EDGES = [0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.01]

# --- fixed values: retrieval ---
RETRIEVAL_TOP_K = 6
CONTEXT_BUDGET = 24_000
CONTEXT_SEPARATOR = "\n\n---\n\n"
SECTION_SPLIT = r"(?m)(?=^## KB-\d{3}:)"
SECTION_TITLE = r"^## (KB-\d{3}):\s*(.+?)\s*$"
SECTION_CHUNK_ID = r"\*\*chunk_id:\*\*\s*`([^`]+)`"
SECTION_KEYWORDS = r"\*\*keywords:\*\*\s*`([^`]+)`"
SECTION_SOURCE = r"\*\*source_of_truth:\*\*\s*`([^`]+)`"

# --- fixed values: views ---
MENTION_LIMIT = 12
MENTION_MIN_LENGTH = 3
PLOT_LIMIT = 100
HEATMAP_ROWS = 24
HEATMAP_SAMPLES = 32

# --- fixed values: meanings shown for the clusters ---
CLUSTER_MEANINGS = {
    0: "Biểu hiện mạnh, mạng cân bằng",
    1: "Thiên về biểu hiện, mạng thấp",
    2: "Protein hub, mạng tương tác mạnh",
}
CLUSTER_MEANING_UNKNOWN = "Chưa có diễn giải"

# --- fixed values: columns of the structured context ---
CONTEXT_TARGET_FIELDS = [
    "rank", "gene_name", "protein_id", "ensp_id", "log2FC", "p_value", "deg_direction", "weighted_degree_protein",
    "avg_combined_score", "num_interactions_in_deg_network", "expression_score", "protein_network_score",
    "string_confidence_score", "final_score", "geo_support_score", "geo_support_level", "geo_match_status", "cluster_id",
    "candidate_group", "gene_confidence",
]
CONTEXT_NETWORK_FIELDS = [
    "rank", "gene_name", "protein_id", "weighted_degree_protein", "degree_protein", "avg_combined_score",
    "num_interactions_in_deg_network", "final_score", "geo_support_level", "cluster_id",
]

# --- fixed value: which edges the network view shows, as text ---
EDGE_FILTER = "edge_weight_protein >= 0.4 and both proteins are in top_candidate_targets_enriched"

# --- fixed values: key figures as (name, unit, phase, description) ---
OVERVIEW_METRICS = [
    ("GDC samples before QC", "samples", "Overview", "Rows in refined GDC quality_check before removing QC outliers."),
    ("GDC samples after QC", "samples", "Phase 1", "Samples passing library-size and detected-gene QC flags."),
    ("Tumor samples", "samples", "Phase 1", "Tumor samples retained after QC."),
    ("Normal samples", "samples", "Phase 1", "Normal samples retained after QC."),
    ("Differentially expressed genes", "genes", "Phase 2", "Genes where Phase 2 is_deg is true."),
    ("DEG mapped to proteins", "genes", "Phase 3", "Distinct DEG genes with STRING protein_id mapping."),
    ("Protein candidates", "proteins", "Phase 5", "Candidate protein rows scored by Phase 5."),
    ("PPI edges in top-target graph", "edges", "Phase 4", "STRING edges among top targets with edge_weight_protein >= 0.4."),
    ("Top candidate targets", "targets", "Phase 5", "Rows in HDFS mart/top_candidate_targets_enriched."),
    ("Candidates with GEO support", "targets", "Phase 6", "Top targets with GEO tumor-cohort expression support metrics."),
    ("ML clusters", "clusters", "Phase 7", "Clusters in analysis/ml_cluster_summary."),
]

# --- fixed values: names of the score components ---
COMPONENT_NAMES = {
    "Expression score": "expression_score", "Protein network score": "protein_network_score", "STRING confidence score": "string_confidence_score",
}

# --- fixed values: columns of the tables and views, in order ---
NODE_COLUMNS = [
    "protein_id", "ensp_id", "gene_name", "rank", "final_score", "log2FC", "p_value", "deg_direction", "degree_protein",
    "weighted_degree_protein", "num_interactions_in_deg_network", "avg_combined_score", "cluster_id", "candidate_group",
    "geo_match_status", "geo_coverage_rate", "geo_mean_percentile", "geo_top_quartile_rate", "geo_support_score",
    "geo_support_level", "gene_confidence",
]
SCATTER_COLUMNS = [
    "rank", "gene_name", "protein_id", "final_score", "geo_support_score", "geo_support_level", "geo_coverage_rate",
    "geo_mean_expression", "geo_median_expression", "geo_mean_percentile", "geo_top_quartile_rate",
]
OVERLAP_COLUMNS = [
    "rank", "gene_name", "protein_id", "final_score", "geo_match_status", "geo_num_samples_available", "geo_total_samples",
    "geo_coverage_rate", "geo_mean_expression", "geo_median_expression", "geo_mean_percentile", "geo_top_quartile_rate",
    "geo_support_score", "geo_support_level",
]
SHOWN_POINT_COLUMNS = [
    "gene_name", "protein_id", "ensp_id", "abs_log2FC", "weighted_degree_protein", "avg_combined_score",
    "num_interactions_in_deg_network", "final_score", "cluster_id", "candidate_group",
]
CANDIDATE_COLUMNS = [
    "rank", "gene_name", "gene_id_base", "protein_id", "ensp_id", "protein_name", "log2FC", "p_value", "deg_direction",
    "degree_protein", "weighted_degree_protein", "num_interactions_in_deg_network", "avg_combined_score",
    "expression_score", "protein_network_score", "string_confidence_score", "final_score",
]
SUPPORTED_COLUMNS = [
    "geo_support_rank", "rank", "gene_name", "protein_id", "ensp_id", "final_score", "geo_coverage_rate",
    "geo_mean_percentile", "geo_top_quartile_rate", "geo_support_score", "geo_support_level",
]
COUNT_COLUMNS = [
    "file_id", "case_id", "sample_id", "sample_type", "sample_group", "gene_id", "gene_id_base", "is_par_y", "gene_name",
    "gene_type", "raw_count", "tpm", "fpkm", "fpkm_uq",
]
POINT_COLUMNS = [
    "gene_name", "gene_id_base", "protein_id", "ensp_id", "protein_name", "log2FC", "abs_log2FC", "weighted_degree_protein",
    "log_weighted_degree", "avg_combined_score", "num_interactions_in_deg_network", "log_num_interactions", "final_score",
]
ENRICHED_SUPPORT = [
    "geo_validation_mode", "geo_match_status", "geo_num_samples_available", "geo_total_samples", "geo_coverage_rate",
    "geo_mean_expression", "geo_median_expression", "geo_mean_percentile", "geo_top_quartile_rate", "geo_support_score", "geo_support_level",
]
