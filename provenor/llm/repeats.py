"""Removal of passages that an earlier document has, found by a count-min prefilter.

A window is ``window`` consecutive words. Its anchor is the smallest hash among
the shorter word runs inside it, so equal windows have equal anchors and about
one anchor stands for a dozen windows. The first pass counts anchors, once per
document, in a count-min sketch: partitions send the cells they touched, the
cells merge by range, and a cell keeps whether two documents or more touched it.
A sketch only overestimates, so every window that repeats has a repeated anchor.
The second pass groups the windows with such anchors by their exact hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenor.llm.packing import deal, dealt, record_batch, shuffle_size, spark_schema
from provenor.llm.words import U, Words, mix, run_hash, slices

WINDOW = 50
RUN_WORDS = 25
SKETCH_BITS = 26  # cells per row of the sketch, as a power of two; two rows travel as 2 bits a cell in all, 16 MB
RANGES = 64
HELD = 1 << 22

TOUCHED = pa.schema([("part", pa.int32()), ("cells", pa.binary()), ("twice", pa.binary())])
BITMAP = pa.schema([("part", pa.int32()), ("bits", pa.binary())])
WINDOWS = pa.schema([("part", pa.int32()), ("hashes", pa.binary()), ("starts", pa.binary()), ("owners", pa.binary()), ("ids", pa.binary()), ("marks", pa.binary())])
MARKS = pa.schema([("__id", pa.int64()), ("__mark", pa.int64()), ("starts", pa.binary())])
SENT = pa.schema([("to", pa.int32()), ("ids", pa.binary()), ("marks", pa.binary()), ("starts", pa.binary())])
LAST = np.iinfo(np.int64).max


def window_anchors(words: Words, window: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts of all windows of the slice and their anchors."""
    count = len(words.hash) - window + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    low, width, size = run_hash(words.hash, run), 1, window - run + 1
    while 2 * width <= size:  # minima over 2, 4, 8 ... runs
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if size > width:
        low = np.minimum(low[: len(low) - (size - width)], low[size - width :])
    last = np.repeat(words.first[1:], words.counts())[:count]
    starts = np.flatnonzero(np.arange(count) + window <= last)
    return starts, low[starts]


def cells(anchors: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = U((1 << bits) - 1)
    return (anchors & mask).astype(np.int64), ((anchors >> U(32)) & mask).astype(np.int64) + (1 << bits)


def partition_sketches(docs: DataFrame, window: int, run: int, bits: int) -> DataFrame:
    """The cells that each partition touched once, and twice or more, by range."""
    per_range = (2 << bits) // RANGES

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if held:
            touched, times = np.unique(np.concatenate(held), return_counts=True)
            rows = []
            for part, at in dealt((touched // per_range).astype(np.int32), RANGES):
                offset = (touched[at] - part * per_range).astype(np.uint32)
                rows.append((part, offset[times[at] == 1].tobytes(), offset[times[at] > 1].tobytes()))
            yield record_batch(TOUCHED, **dict(zip(TOUCHED.names, map(list, zip(*rows, strict=True)), strict=True)))

    def go(batches):
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), lower=False)
                starts, anchors = window_anchors(words, window, run)
                if not len(starts):
                    continue
                owner = words.owner()[starts]
                new = np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])])
                owner, anchors = owner[new], anchors[new]
                order = np.lexsort((anchors, owner))
                owner, anchors = owner[order], anchors[order]
                anchors = anchors[np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])])]
                held.extend(cells(anchors, bits))
                size += 2 * len(anchors)
                if size > HELD:
                    yield from flush(held)
                    held, size = [], 0
        yield from flush(held)

    return docs.mapInArrow(go, spark_schema(TOUCHED))


def merged_sketch(touched: DataFrame, bits: int) -> np.ndarray:
    """One bit per cell: touched by two documents or more. Its size is fixed by ``bits``, whatever the input."""
    per_range = (2 << bits) // RANGES

    def go(batches):
        ranges: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                counts = ranges.setdefault(row["part"], np.zeros(per_range, np.uint8))
                counts[np.frombuffer(row["twice"], np.uint32)] = 2
                once = np.frombuffer(row["cells"], np.uint32)
                counts[once] = np.minimum(counts[once] + 1, 2)
        for part, counts in ranges.items():
            yield record_batch(BITMAP, part=[part], bits=[np.packbits(counts > 1, bitorder="little").tobytes()])

    out = np.zeros((2 << bits) // 8, np.uint8)
    for row in deal(touched, RANGES).mapInArrow(go, spark_schema(BITMAP)).toLocalIterator():
        at = row["part"] * per_range // 8
        out[at : at + per_range // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def repeated_cells(bitmap: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (bitmap[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0


def candidate_windows(docs: DataFrame, bitmap, window: int, run: int, bits: int, parts: int) -> DataFrame:
    """Windows estimated repeated, packed by hash. ``part`` -1 has those that a smaller id of the same slice also has."""
    def go(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), lower=False)
                starts, anchors = window_anchors(words, window, run)
                a, b = cells(anchors, bits)
                hit = repeated_cells(bitmap.value, a)
                hit[hit] = repeated_cells(bitmap.value, b[hit])
                starts = starts[hit]
                if not len(starts):
                    continue
                hashes = run_hash(words.hash, window)[starts]
                owner = words.owner()[starts]
                ids = part.column("__id").to_numpy(zero_copy_only=False)
                marks = part.column("__mark").to_numpy(zero_copy_only=False)
                places = (starts - words.first[owner]).astype(np.int32)
                order = np.lexsort((ids[owner], hashes))
                hashes, owner, places = hashes[order], owner[order], places[order]
                first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
                least = np.repeat(ids[owner[first]], np.diff(np.concatenate([first, [len(hashes)]])))
                later = ids[owner] > least
                rows = []
                sendings = [(-1, np.flatnonzero(later))] if later.any() else []
                stay = np.flatnonzero(~later)
                sendings += [(p, stay[at]) for p, at in dealt(((hashes[stay] >> U(32)) * U(parts) >> U(32)).astype(np.int32), parts)]
                for p, at in sendings:
                    own, local = np.unique(owner[at], return_inverse=True)
                    rows.append((
                        p, hashes[at].tobytes() if p >= 0 else b"", places[at].tobytes(), local.astype(np.uint32).tobytes(), ids[own].astype(np.int64).tobytes(),
                        marks[own].astype(np.int64).tobytes(),
                    ))
                yield record_batch(WINDOWS, **dict(zip(WINDOWS.names, map(list, zip(*rows, strict=True)), strict=True)))

    return docs.mapInArrow(go, spark_schema(WINDOWS))


def _by_document(ids: np.ndarray, marks: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((marks, ids))
    ids, marks, starts = ids[order], marks[order], starts[order]
    first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])]))
    ends = [*first[1:], len(ids)]
    return record_batch(MARKS, __id=ids[first], __mark=marks[first], starts=[starts[a:b].tobytes() for a, b in zip(first, ends, strict=True)])


def _sent(ids: np.ndarray, marks: np.ndarray, starts: np.ndarray, parts: int) -> pa.RecordBatch:
    """Starts on their way to the part of their document."""
    to = ((mix(marks.view(U)) >> U(32)) * U(parts) >> U(32)).astype(np.int32)
    rows = [(p, ids[at].tobytes(), marks[at].tobytes(), starts[at].tobytes()) for p, at in dealt(to, parts)]
    return record_batch(SENT, **dict(zip(SENT.names, map(list, zip(*rows, strict=True)), strict=True)))


def later_windows(windows: DataFrame, parts: int) -> DataFrame:
    """Starts of windows that a document with a smaller id also has, one row per document."""
    def unpack(rows: list[dict]) -> list[np.ndarray]:
        read = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in rows])
        owners = [np.frombuffer(r["owners"], np.uint32) for r in rows]
        spread = lambda name: np.concatenate([np.frombuffer(r[name], np.int64)[o] for r, o in zip(rows, owners, strict=True)])
        return [read("hashes", U), read("starts", np.int32), spread("ids"), spread("marks")]

    def compare(batches):
        rows: dict[int, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] < 0:
                    _, starts, ids, marks = unpack([row])
                    yield _sent(ids, marks, starts, parts)
                else:
                    rows.setdefault(row["part"], []).append(row)
        for own in rows.values():
            hashes, starts, ids, marks = unpack(own)
            order = np.lexsort((ids, hashes))
            hashes, starts, ids, marks = hashes[order], starts[order], ids[order], marks[order]
            first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            later = ids > np.repeat(ids[first], np.diff(np.concatenate([first, [len(ids)]])))
            if later.any():
                yield _sent(ids[later], marks[later], starts[later], parts)

    def gather(batches):
        held = [[np.frombuffer(row[c], k) for c, k in (("ids", np.int64), ("marks", np.int64), ("starts", np.int32))] for batch in batches for row in batch.to_pylist()]
        if held:
            yield _by_document(*(np.concatenate(x) for x in zip(*held, strict=True)))

    spread = windows.withColumn("to", F.when(F.col("part") < 0, F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int")).otherwise(F.col("part")))
    sent = deal(spread, parts, "to").drop("to").mapInArrow(compare, spark_schema(SENT))
    return deal(sent, parts, "to").mapInArrow(gather, spark_schema(MARKS))


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, run: int = RUN_WORDS, bits: int = SKETCH_BITS) -> DataFrame:
    """The rows of ``df`` with ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by one space).

    A word goes when a window that covers it also starts in a row with a smaller
    id; windows are judged on the input. Rows with equal ids do not remove each
    other's words; a null id counts as larger than all others. A null, empty or
    blank text has no words and an empty ``kept_text``; a text of fewer words
    than a window is kept whole. Columns named like a result give way to it. An
    empty table gives an empty one. Windows are told apart by 64-bit hashes.

    Each slice of texts settles its own copies before the shuffle, so a passage
    in a third of all rows meets once per slice. The merged sketch has a fixed
    size: on more input it lets more windows through to the exact grouping, and
    still loses none.
    """
    spark = df.sparkSession
    results = ("n_words", "n_removed", "kept_text")
    keep = [c for c in df.columns if c not in results]
    identity = [F.coalesce(df[key].cast("bigint"), F.lit(int(LAST))).alias("__id"), F.xxhash64(F.coalesce(df[text], F.lit(""))).alias("__mark")]
    docs = df.select(*identity, df[text].alias("text"))
    bitmap = spark.sparkContext.broadcast(merged_sketch(partition_sketches(docs.select("text"), window, run, bits), bits))
    parts = shuffle_size(spark)
    marks = later_windows(candidate_windows(docs, bitmap, window, run, bits, parts), parts).withColumnRenamed("starts", "__starts")
    body = f"__in_{text}" if text in keep else "__text"  # a text to return is shuffled and goes to the tasks once
    joined = df.select(*(df[c].alias(f"__in_{c}") for c in keep), *identity, *([] if text in keep else [df[text].alias(body)])).join(marks, ["__id", "__mark"], "left").drop("__id", "__mark")
    kept = [f"__in_{c}" for c in keep]
    made = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.select(*kept).schema), spark_schema(made)])

    def go(batches):
        for batch in batches:
            for part in slices(batch, body):
                rows = []
                for value, starts in zip(part.column(body).to_pylist(), part.column("__starts").to_pylist(), strict=True):
                    words = (value or "").encode().split()
                    gone = 0
                    if starts:
                        edges = np.zeros(len(words) + 1, np.int32)
                        at = np.frombuffer(starts, np.int32)
                        np.add.at(edges, at, 1)
                        np.add.at(edges, at + window, -1)
                        covered = np.cumsum(edges[:-1]) > 0
                        gone = int(covered.sum())
                        words_kept = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                    else:
                        words_kept = words
                    rows.append((len(words), gone, b" ".join(words_kept).decode()))
                out = record_batch(made, **dict(zip(made.names, map(list, zip(*rows, strict=True)), strict=True)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *out.columns], names=[*kept, *made.names])

    out = joined.mapInArrow(go, schema)
    return out.select(*(F.col(f"__in_{c}").alias(c) for c in keep), *results)
