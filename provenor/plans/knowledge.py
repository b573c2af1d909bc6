"""Knowledge documents: sections with metadata, their embedding text, and the changes to an index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenor.functions import embedding_text
from provenor.operators.retrieval import check_chunks, chunk_sections
from provenor.operators.sets import id_diff, upsert
from provenor.sinks.tables import export_vectors


def knowledge_chunks(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Sections of markdown files: id, title, text, metadata and the text to embed."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), "value")
    parts = chunk_sections(files, ["source_file"], "value")
    titled = F.concat(F.col("section_id"), F.lit(": "), F.col("title"))
    pairs = [x for k, c in {
        "kb_id": "section_id", "title": "title", "keywords": "keywords", "source_of_truth": "source_of_truth", "source_file": "source_file",
    }.items() for x in (F.lit(k), F.col(c))]
    return parts.select(
        F.col("chunk_id").alias("id"), titled.alias("title"), "text", F.create_map(*pairs).alias("metadata"),
        embedding_text(titled, "text").alias("embedding_text"),
    )


def checked_chunks(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The same, after an error for no sections or repeated ids."""
    chunks = knowledge_chunks(spark, path)
    check_chunks(chunks, "id")
    return chunks


def index_changes(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ids to delete (stale) and ids that are new."""
    return id_diff(index, chunks, "id")


def refresh_index(index: DataFrame, embedded: DataFrame, path: str) -> None:
    """Replace the stored index by the embedded chunks; what they lack is stale and goes."""
    export_vectors(upsert(index.select("id", "text", "metadata", "embedding"), embedded, "id"), path, "id", "text", "metadata", "embedding")
