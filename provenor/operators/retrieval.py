"""Text sections, nearest passages and context assembly."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provenor import constants as K
from provenor.functions import extract_id, similarity
from provenor.operators.sorting import n_per_group, top_k
from provenor.operators.windows import pack_context
from provenor.session import materialise


def chunk_sections(
    df: DataFrame,
    keep: Sequence[str],
    text: str,
    split: str = K.SECTION_SPLIT,
    starts: str = r"^## KB-",
    title: str = K.SECTION_TITLE,
    chunk_id: str | None = K.SECTION_CHUNK_ID,
    attrs: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per section: its number, id, title, trimmed text and attributes.

    A section begins where ``split`` matches; sections that do not begin with
    ``starts`` or whose first line does not match ``title`` (section id, title)
    are left out. Without an own id the lower-cased section id is used.
    """
    attrs = {"keywords": K.SECTION_KEYWORDS, "source_of_truth": K.SECTION_SOURCE} if attrs is None else attrs
    parts = df.select(*keep, F.posexplode(F.split(F.col(text), split)).alias("section_no", "__part"))
    trimmed = parts.select(*keep, "section_no", F.regexp_replace("__part", r"^\s+|\s+$", "").alias("text"))
    head = F.rtrim(F.element_at(F.split(F.col("text"), r"\r?\n"), 1))
    section = F.regexp_extract(head, title, 1)
    own = extract_id("text", chunk_id) if chunk_id else F.lit(None).cast("string")
    return trimmed.where(F.col("text").rlike(starts) & head.rlike(title)).select(
        *keep,
        "section_no",
        F.coalesce(own, F.lower(section)).alias("chunk_id"),
        section.alias("section_id"),
        F.regexp_extract(head, title, 2).alias("title"),
        *[F.regexp_extract("text", p, 1).alias(n) for n, p in attrs.items()],
        "text",
    )


def duplicate_chunks(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chunk ids that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def check_chunks(df: DataFrame, key: str = "chunk_id") -> int:
    """Number of chunks; error when there are none or ids repeat."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("ids")).first()
    if row["n"] == 0:
        raise ValueError("no sections found")
    if row["n"] != row["ids"]:
        raise ValueError(f"duplicate chunk ids: {row['n'] - row['ids']}")
    return row["n"]


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, np.nan, norms)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """A list column as one matrix of unit rows."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(flat.reshape(len(vectors), -1))


def _first_k(group: np.ndarray, distance: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest (distance, id) of every group."""
    order = np.lexsort((ids, distance, group))
    g = group[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    place = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
    return order[place < k]


def _best(q: np.ndarray, p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question row, passage row, distance) of the k nearest passages per question within one block.

    Passages stand in the order of their ids, so of equal distances the first
    rows win, and k rows per question are kept however many distances are equal.
    """
    distance = np.nan_to_num(1.0 - q @ p.T, nan=np.inf)
    n = min(k, distance.shape[1])
    kth = np.partition(distance, n - 1, axis=1)[:, [n - 1]]
    near = distance < kth
    ties = distance == kth
    near |= ties & (np.cumsum(ties, axis=1) <= n - near.sum(axis=1, keepdims=True))
    rows, cols = np.nonzero(near)
    return rows, cols, distance[rows, cols]


def cosine_topk(
    questions: DataFrame,
    passages: DataFrame,
    question_id: str,
    question_vec: str,
    passage_id: str,
    passage_vec: str,
    k: int = K.RETRIEVAL_TOP_K,
    question_block: int = 1024,
    passage_bytes: int = 64 << 20,
) -> DataFrame:
    """The exact k nearest passages by cosine distance for every question.

    The work is cut in tiles of one block of questions and one chunk of passages.
    Passages are scanned in place, once, and never shuffled; a task holds a chunk of
    ``passage_bytes`` of vectors, reads the stored questions in blocks of ``question_block``
    once per chunk and passes on k candidates per question of the block at hand. It keeps
    nothing else, so its memory grows neither with the questions nor with the passages;
    the candidates of all chunks are cut to k by Spark. Null vectors are left out; a
    vector of zeros is infinitely far. The shared folder must be a URI that
    pyarrow opens: ``file:``, ``hdfs:``, ``s3:`` (also written ``s3a:``), ``gs:``, ``abfs:`` (also ``abfss:``).
    """
    q = questions.select(F.col(question_id).alias("question"), F.col(question_vec).cast("array<double>").alias("vec")).where("vec IS NOT NULL")
    p = passages.select(F.col(passage_id).alias("passage"), F.col(passage_vec).cast("array<double>").alias("vec")).where("vec IS NOT NULL")
    types = {f.name: f.dataType.simpleString() for f in (*q.schema, *p.schema)}
    schema = f"question {types['question']}, passage {types['passage']}, distance double"
    stored = materialise(q, "questions")
    files = sorted(stored.inputFiles())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return tiles(batches, lambda: _question_blocks(files, question_block), k, passage_bytes)

    near = p.mapInArrow(scan, schema)
    chosen = n_per_group(near, ["question"], [F.col("distance").asc(), F.col("passage").asc()], k, number="place")
    return chosen.withColumn("similarity", similarity("distance"))


TILE_CELLS = 1 << 22


def tiles(batches: Iterator[pa.RecordBatch], blocks: Callable[[], Iterator[pa.RecordBatch]], k: int, passage_bytes: int) -> Iterator[pa.RecordBatch]:
    """(question, passage, distance) of the k nearest passages of each chunk for every question, one block of questions at a time."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= passage_bytes:
            yield from _tiles_of_chunk(held, blocks, k)
            held, size = [], 0
    yield from _tiles_of_chunk(held, blocks, k)


def _tiles_of_chunk(held: Sequence[pa.RecordBatch], blocks: Callable[[], Iterator[pa.RecordBatch]], k: int) -> Iterator[pa.RecordBatch]:
    chunk = pa.Table.from_batches(held).sort_by("passage").combine_chunks() if held else None
    if chunk is None or not chunk.num_rows:
        return
    id_type, ids = chunk.schema.field("passage").type, chunk.column("passage").to_numpy()
    unit = _matrix(chunk.column("vec").combine_chunks())
    for block in blocks():
        if not block.num_rows:
            continue
        vectors, found = _matrix(block.column("vec")), None
        step = max(k, TILE_CELLS // block.num_rows)
        for at in range(0, len(ids), step):
            rows, cols, distance = _best(vectors, unit[at : at + step], k)
            new = (rows, ids[at + cols], distance)
            if found is not None:
                new = tuple(np.concatenate(c) for c in zip(found, new, strict=True))
                keep = _first_k(new[0], new[2], new[1], k)
                new = tuple(c[keep] for c in new)
            found = new
        rows, near, distance = found
        yield pa.RecordBatch.from_arrays([block.column("question").take(pa.array(rows)), pa.array(near, type=id_type), pa.array(distance)], ["question", "passage", "distance"])


def _question_blocks(files: Sequence[str], size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the stored questions."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    for uri in files:
        scheme, rest = uri.split(":", 1)
        filesystem, path = fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3", "abfss": "abfs"}.get(scheme, scheme) + ":" + rest)
        with filesystem.open_input_file(path) as f:
            yield from pq.ParquetFile(f).iter_batches(size)


def assemble_context(
    ranked: DataFrame, keys: Sequence[str], order: Sequence[Column], label: str, text: str, passage: str,
    budget: int = K.CONTEXT_BUDGET, separator: str = K.CONTEXT_SEPARATOR,
) -> DataFrame:
    """Labelled passages joined in rank order under a length budget, one text per key.

    Rows are ranked by lengths and the unique id ``passage`` alone; only the texts
    of the rows that fit are fetched.
    """
    part = F.concat(F.lit("["), F.coalesce(F.col(label), F.lit("KB")), F.lit("]\n"), F.col(text))
    lengths = ranked.withColumn("__len", F.length(part).cast("bigint")).drop(label, text)
    packed = pack_context(lengths, keys, order, "__len", budget).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(passage).alias("__id"), "place", "used")
    same = F.lit(True)
    for k in keys:
        same = same & ranked[k].eqNullSafe(F.col(f"__{k}"))
    chosen = ranked.withColumn("__part", part).join(packed, same & (ranked[passage] == F.col("__id")))
    joined = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "__part"))), lambda s: s["__part"]), separator
    )
    return chosen.groupBy(*keys).agg(joined.alias("context"), F.count(F.lit(1)).alias("n_passages"), F.max("used").alias("n_chars"))


def citations(ranked: DataFrame, keep: Sequence[str], distance: str) -> DataFrame:
    """Citation rows: attributes with the similarity rounded to four digits."""
    return ranked.select(*keep, F.round(similarity(distance), 4).alias("similarity"))


def context_bundle(parts: Mapping[str, tuple[DataFrame, Sequence[Column], int | None]], counts: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """One JSON record of lists: ``{name: (frame, order, limit)}`` plus row counts.

    A limit of None takes all rows: only for frames with a row per category.
    """
    spark = next(iter(parts.values()))[0].sparkSession
    cells = []
    for name, (frame, order, limit) in parts.items():
        numbered = frame.withColumn("__no", F.row_number().over(W.orderBy(*order))) if limit is None else top_k(frame, order, limit, rank="__no")
        items = F.sort_array(F.collect_list(F.struct("__no", F.struct(*frame.columns).alias("row"))))
        listed = numbered.agg(items.alias("items")).select(F.transform("items", lambda s: s["row"]).alias("items"))
        cells.append(listed.scalar().alias(name))
    for name, frame in (counts or {}).items():
        cells.append(frame.agg(F.count(F.lit(1)).alias("n")).scalar().alias(name))
    one = spark.range(1).select(*cells)
    return one.select(F.to_json(F.struct(*one.columns), {"ignoreNullFields": "false"}).alias("bundle"))
