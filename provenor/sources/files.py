"""Readers for nested JSON, TSV, whitespace-delimited and sectioned text files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenor import constants as K
from provenor.functions import file_name, label_group

INDEX_SCHEMA = (
    "data struct<hits: array<struct<file_id: string, file_name: string, cases: array<struct<case_id: string, "
    "samples: array<struct<sample_id: string, sample_type: string, tissue_type: string>>>>>>>"
)


def flatten_index(df: DataFrame) -> DataFrame:
    """``data.hits[] -> cases[] -> samples[]`` to one row per file, case and sample."""
    hit = df.select(F.explode_outer("data.hits").alias("hit"))
    case = hit.select("hit.file_id", "hit.file_name", F.explode_outer("hit.cases").alias("case"))
    sample = case.select("file_id", "file_name", "case.case_id", F.explode_outer("case.samples").alias("sample"))
    return (
        sample.select("file_id", "file_name", "case_id", "sample.sample_id", "sample.sample_type", "sample.tissue_type")
        .where(F.col("file_id").isNotNull())
        .withColumn("sample_group", label_group("sample_type", "tissue_type"))
        .groupBy("file_id", "case_id", "sample_id")
        .agg(*[F.min(c).alias(c) for c in ("file_name", "sample_type", "tissue_type", "sample_group")])
    )


def read_nested_index(spark: SparkSession, path: str | Sequence[str], schema: str = INDEX_SCHEMA, multi_line: bool = True) -> DataFrame:
    """One document per file, or one per line, which a large file can be split at."""
    return flatten_index(spark.read.schema(schema).option("multiLine", multi_line).json(path))


def read_tsv(spark: SparkSession, path: str | Sequence[str], schema: str | None = None, comment: str | None = None) -> DataFrame:
    """Tab-separated table with a header line; all columns are text unless a schema is given."""
    reader = spark.read.option("header", True).option("sep", "\t").option("mode", "PERMISSIVE")
    if schema:
        reader = reader.schema(schema)
    if comment:
        reader = reader.option("comment", comment)
    return reader.csv(path)


def with_lineage(df: DataFrame, id_pattern: str = r"file_id=([^/]+)") -> DataFrame:
    """Path, file name and the id found in the path of every row's file."""
    path = F.col("_metadata.file_path")
    return df.select("*", path.alias("file_path")).withColumns({
        "file_id": F.regexp_extract("file_path", id_pattern, 1),
        "file_name": file_name("file_path"),
    })


def read_counts(spark: SparkSession, path: str | Sequence[str], schema: str | None = None, id_pattern: str = r"file_id=([^/]+)") -> DataFrame:
    """Many count files with the id of the folder each row came from; ``#`` lines are skipped."""
    return with_lineage(read_tsv(spark, path, schema, comment="#"), id_pattern)


def file_inventory(spark: SparkSession, path: str | Sequence[str], id_pattern: str = r"file_id=([^/]+)") -> DataFrame:
    """One name and path per file id of the listed files, the smallest where there are several; no content is read."""
    listed = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file_path"))
    found = listed.select("file_path", F.regexp_extract("file_path", id_pattern, 1).alias("file_id"), file_name("file_path").alias("file_name"))
    return found.where(F.col("file_id") != "").groupBy("file_id").agg(
        F.min("file_name").alias("count_file_name"), F.min("file_path").alias("count_file_path")
    )


def _content(lines: DataFrame, line: str) -> DataFrame:
    """Trimmed lines without blanks and comments."""
    trimmed = lines.withColumn(line, F.trim(line))
    return trimmed.where((F.col(line) != "") & ~F.col(line).startswith("#"))


def _once(c: Column) -> Column:
    """A costly value that later filters and columns share: a generator keeps them from repeating it."""
    return F.explode(F.array(c))


def parse_edge_lines(lines: DataFrame, line: str = "value", headers: Sequence[str] = tuple(K.LINK_HEADERS)) -> DataFrame:
    """``source target score`` lines; short lines, headers and unreadable scores are dropped."""
    parts = _content(lines, line).select(_once(F.split(line, r"\s+")).alias("__p")).where(F.size("__p") >= 3)
    return (
        parts.select(F.col("__p")[0].alias("src"), F.col("__p")[1].alias("dst"), F.col("__p")[2].try_cast("double").alias("score"))
        .where(~F.lower("src").isin(*headers) & F.col("score").isNotNull())
    )


def read_edge_text(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return parse_edge_lines(spark.read.text(path))


def parse_alias_lines(lines: DataFrame, line: str = "value", headers: Sequence[str] = tuple(K.ALIAS_HEADERS)) -> DataFrame:
    """``id alias source`` lines, split at tabs where that gives three parts, else at white space."""
    tabs = F.split(line, "\t")
    parts = F.when(F.size(tabs) >= 3, tabs).otherwise(F.split(line, r"\s+"))
    return (
        _content(lines, line).select(_once(parts).alias("__p")).where(F.size("__p") >= 3)
        .select(F.col("__p")[0].alias("protein_id"), F.col("__p")[1].alias("alias_value"), F.col("__p")[2].alias("source"))
        .where(~F.lower("protein_id").isin(*headers))
    )


def read_alias_text(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return parse_alias_lines(spark.read.text(path))


def section_from(lines: DataFrame, doc: Sequence[str], pos: str, starts: Column) -> DataFrame:
    """Lines of each document from its first starting line on; documents without one are left out.

    Bounds are one row per document, so adaptive execution broadcasts them or
    splits the lines of a large document.
    """
    first = lines.where(starts).groupBy(*doc).agg(F.min(pos).alias("__start"))
    return lines.join(first, list(doc)).where(F.col(pos) >= F.col("__start")).drop("__start")


def section_between(lines: DataFrame, doc: Sequence[str], pos: str, begin: Column, end: Column) -> DataFrame:
    """Lines strictly between the first begin line and the first end line after it."""
    begins = lines.where(begin).groupBy(*doc).agg(F.min(pos).alias("__begin"))
    ends = (
        lines.where(end).select(*doc, pos).join(begins, list(doc)).where(F.col(pos) > F.col("__begin"))
        .groupBy(*doc).agg(F.min("__begin").alias("__begin"), F.min(pos).alias("__end"))
    )
    inside = (F.col(pos) > F.col("__begin")) & (F.col(pos) < F.col("__end"))
    return lines.join(ends, list(doc)).where(inside).drop("__begin", "__end")


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines with their file and a position that orders them within the file.

    A task reads a block of a file from top to bottom, so the block start and the
    row id inside the task give file order without a pass over the data.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
        ).alias("pos"),
        F.regexp_replace("value", r"\r+$", "").alias("line"),
    )


def _as_table(spark: SparkSession, path: str | Sequence[str], body: DataFrame, sep: str = "\t") -> DataFrame:
    """Lines whose first line per file is its header, as a table of text columns; every file is read by its own header.

    Columns are those of all headers, in the order of the first file that has
    them; a column that a file lacks is null there. Distinct header lines alone travel
    to the driver. Raises with the names of the first files that have no section.
    """
    firsts = body.groupBy("file_path").agg(F.min_by("line", "pos").alias("__names"), F.min("pos").alias("__head"))
    heads = [r["__names"] for r in firsts.groupBy("__names").agg(F.min("file_path").alias("f")).orderBy("f").collect()]
    listed = spark.read.format("binaryFile").load(path).select("path", _plain_path("path").alias("__plain"))
    without = listed.join(firsts.select(_plain_path("file_path").alias("__plain")), "__plain", "left_anti")
    lacking = [r["path"] for r in without.select("path").orderBy("path").limit(NAMED_FILES).collect()]
    if lacking or not heads:
        raise ValueError("no section found in " + ", ".join(lacking or ["any file"]))
    names = list(dict.fromkeys(n for head in heads for n in head.split(sep)))
    places = F.transform(F.array(*map(F.lit, names)), lambda n: F.array_position(F.split("__names", sep, -1), n).cast("int"))
    rows = body.join(firsts.select("file_path", "__head", places.alias("__places")), "file_path").where((F.col("pos") > F.col("__head")) & (F.trim("line") != ""))
    fields = [f"c{i}" for i in range(max(len(h.split(sep)) for h in heads))]
    cells = F.from_csv("line", F.lit(", ".join(f"{c} string" for c in fields)), {"sep": sep, "mode": "PERMISSIVE"})
    keyed = rows.select(cells.alias("__row"), "__places").select(_once(F.array(*[F.col(f"__row.{c}") for c in fields])).alias("__cells"), "__places")
    return keyed.select(*[F.get("__cells", F.get("__places", F.lit(i)) - 1).alias(n) for i, n in enumerate(names)])


def _plain_path(path: str) -> Column:
    """A path without the slashes and escapes in which listings and metadata differ."""
    return F.regexp_replace(F.url_decode(F.replace(F.col(path), F.lit("+"), F.lit("%2B"))), r"^([a-z0-9]+:)/+", "$1/")


# of files without a section so many are named
NAMED_FILES = 20


def read_from_header(spark: SparkSession, path: str | Sequence[str], prefix: str = K.EXPRESSION_HEADER_PREFIX) -> DataFrame:
    """Table that begins at the first line with ``prefix``; error when a file has none."""
    return _as_table(spark, path, section_from(read_lines(spark, path), ["file_path"], "pos", F.col("line").startswith(prefix)))


def read_between(spark: SparkSession, path: str | Sequence[str], begin: str = K.METADATA_BEGIN, end: str = K.METADATA_END) -> DataFrame:
    """Table between two marker lines; error when a file lacks a marker."""
    lines = read_lines(spark, path)
    text = F.trim("line")
    return _as_table(spark, path, section_between(lines, ["file_path"], "pos", text == begin, text == end))
