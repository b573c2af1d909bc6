"""Column functions; all of them stay inside the JVM."""

from provenor.functions.numeric import (
    blend,
    clamp01,
    erfc,
    finite_or_null,
    log2p1,
    neg_log10,
    node_size,
    ratio,
    similarity,
    two_sided_p,
    zero_if_null,
)
from provenor.functions.text import (
    blank,
    csv_guard,
    embedding_text,
    extract_id,
    file_name,
    id_parts,
    label_group,
    norm_key,
    not_blank,
    question_text,
)

__all__ = [
    "blank", "blend", "clamp01", "csv_guard", "embedding_text", "erfc", "extract_id", "file_name",
    "finite_or_null", "id_parts", "label_group", "log2p1", "neg_log10", "node_size", "norm_key",
    "not_blank", "question_text", "ratio", "similarity", "two_sided_p", "zero_if_null",
]
