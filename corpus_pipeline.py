"""A corpus pipeline: quality rules, near duplicates, repeated passages, benchmark leaks, token ids.

Every stage takes and returns the columns of ``documents`` (the last one: token
ids) and works on all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenor.llm import fertility, jaccard, latent, repeats, spm
from provenor.llm.queries import PIECE_MODEL, ship
from provenor.session import working_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts go."""
    ship(spark)
    judged = fertility.quality_rules(docs, fertility.model_bytes(spark, PIECE_MODEL))
    return judged.where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; of rows that share an id, one. Documents without an id stay."""
    ship(spark)
    groups = jaccard.near_duplicates(docs)
    stay = groups.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document with a smaller id has; a text that loses words is its other words joined by one space.

    Documents that lose all words go; texts that lose none stay as they are.
    """
    ship(spark)
    cut = repeats.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    kept = cut.where("n_removed = 0 or n_removed < n_words").withColumn("text", text)
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    ship(spark)
    found = latent.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_ids`` and ``ids``: the pieces of each text."""
    ship(spark)
    encoded = spm.encode(docs, fertility.model_bytes(spark, PIECE_MODEL), keep=("doc_id",))
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids")


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substrings),
    ("benchmark decontamination", leaks),
    ("SentencePiece encoding", token_ids),
]

#: Token ids, sketches and fertility are not SQL; tests/llm compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = working_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
