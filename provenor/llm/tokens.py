"""Token ids in Re-Pair compressed files, read back whole or from any place.

Texts are encoded where they lie; their ids go once through a shuffle that deals
them by range of document id, and each range is written as shards. A shard is one
file: the rules of its grammar with their expansion lengths, the symbols of its
documents, and an index of documents, so that any run of ids is found by a search
in the running lengths and only the symbols over it are expanded. A file counts
only when the manifest, which Spark commits as a whole, names it, so files of failed attempts
do no harm. Paths are URIs that pyarrow opens (``file:``, ``hdfs:``, ``s3:``, ``gs:``).
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenor.llm.grammar import Expander, compress, ragged, symbol_lengths
from provenor.llm.packing import record_batch, shuffle_size, spark_schema
from provenor.llm.warc import _open
from provenor.llm.words import range_hash, slices, text_bytes
from provenor.operators.ordering import number_rows

SHARD_IDS = 1 << 21  # a shard closes at the end of the document with which it reaches so many ids
ROUNDS, PER_ROUND, LEAST = 6, 2500, 4
REMEMBERED = 600_000
RANGES_A_PARTITION, SAMPLES_A_RANGE = 4, 16

#: Fixed values of the file format.
MAGIC = b"RPIDS\x00\x00\x01"
HEAD = struct.Struct("<8sIIQQQ")

ENCODED = pa.schema([("range", pa.int32()), ("doc", pa.int64()), ("h", pa.int64()), ("ids", pa.binary())])
FILES = pa.schema([("file", pa.string()), ("range", pa.int32()), ("number", pa.int32()), ("bytes", pa.int64()), ("documents", pa.int64()), ("ids", pa.int64()), ("symbols", pa.int64()), ("rules", pa.int64()), ("sha256", pa.string())])
DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("file", pa.string())])

_SPACE, _SIGN, _ALNUM, _LEAD, _WIDE = 1, 2, 4, 8, 16
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 32]] = _SPACE
_KIND[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = _SIGN
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = _ALNUM
_KIND[0xC3:0xCA] = _LEAD  # two-byte letters U+00C0 to U+027F
_KIND[0xE1:0xE4] = _WIDE  # three-byte characters, blanks among them


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places at which byte-level BPE always splits UTF-8 texts, so that what lies between can be encoded on its own.

    These are the starts of the texts, blanks after another character than a blank, and ASCII signs
    after an ASCII letter or digit or a Latin letter.
    """
    kind = _KIND[data]
    at = np.flatnonzero((kind == _SPACE) | (kind == _SIGN))
    at = at[at > 0]
    one, two, three = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    many = one >= 0x80
    blank = np.where(many, np.where(two >= 0xC0, two == 0xC2, _KIND[three] == _WIDE), (one <= 0x20) | (one == 0x7F))
    letter = (_KIND[one] == _ALNUM) | (many & (_KIND[two] == _LEAD) & ~((two == 0xC3) & ((one == 0x97) | (one == 0xB7))))
    cut = np.zeros(len(data) + 1, bool)
    cut[at[np.where(kind[at] == _SPACE, ~blank, letter)]] = True
    cut[offsets] = True
    return np.flatnonzero(cut[:-1])


class Encoder:
    """Texts to ids with the ``tokenizers`` library, which encodes each distinct piece (see ``piece_starts``) once.

    Pieces are told apart by 64-bit hashes. New ones go to the library in rows of ``TOGETHER``, which
    it splits at their blanks; the bytes of the ids tell where each piece ends. Strings of special
    tokens in a text are ordinary text.
    """

    TOGETHER = 64

    def __init__(self, model: bytes, dtype):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(model)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype(dtype)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 2, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(piece) for piece in vocabulary]  # one character stands for one byte
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.pool, self.start, self.length = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _found(self, rows: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(rows, add_special_tokens=False)]

    def _learn(self, hashes: list[int], pieces: list[str]) -> None:
        """Adds pieces: those that begin with a blank and end without may stand one after the other."""
        chain = [k for k, p in enumerate(pieces) if p[0] in " \n\t" and not p[-1].isspace()]
        joined, n = set(chain), self.TOGETHER
        apart = [k for k in range(len(pieces)) if k not in joined]
        alone = self._found([pieces[k] for k in apart])
        rows = self._found(["".join(pieces[j] for j in chain[k : k + n]) for k in range(0, len(chain), n)])
        ids = np.concatenate([np.zeros(0, self.dtype), *rows])
        upto, ends = np.cumsum(self.bytes_of[ids]), np.cumsum([len(pieces[k].encode()) for k in chain])
        stops = np.searchsorted(upto, ends) + 1
        if len(chain) and (upto[-1] != ends[-1] or (upto[stops - 1] != ends).any()):
            raise ValueError("the tokenizer does not split at blanks")
        lengths = np.concatenate([np.diff(np.concatenate([[0], stops])), np.array([len(x) for x in alone], np.int64)]).astype(np.int64)
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.pool = np.concatenate([self.pool, ids, *alone])
        base = len(self.known)
        self.known.update((hashes[k], base + j) for j, k in enumerate([*chain, *apart]))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; a null is empty."""
        data, offsets = text_bytes(texts)
        starts = piece_starts(data, offsets)
        ends = np.concatenate([starts[1:], [len(data)]])[: len(starts)]
        names, first, which = np.unique(range_hash(data, starts, ends), return_index=True, return_inverse=True)
        listed = names.tolist()
        new = [k for k, h in enumerate(listed) if h not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self._forget()
            new = list(range(len(listed)))
        if new:
            whole = data.tobytes()
            self._learn([listed[k] for k in new], [whole[starts[k] : ends[k]].decode() for k in first[new]])
        number = np.array([self.known[h] for h in listed], np.int64)[which]
        sizes = self.length[number]
        ids = self.pool[ragged(self.start[number], sizes)]
        upto = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, offsets)]
        return [ids[a:b] for a, b in zip(upto[:-1], upto[1:], strict=True)]


@lru_cache(1)
def encoder(model: bytes, dtype: str) -> Encoder:
    """One per worker process, kept for its next tasks."""
    return Encoder(model, dtype)


def vocabulary_size(model: bytes) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_buffer(model).get_vocab_size(with_added_tokens=True)


def range_bounds(rows: DataFrame, n: int) -> list[tuple]:
    """Up to n - 1 places (has an id, id, hash) that cut the rows (``doc``, ``h``, ``size``) in ranges of about equal size.

    They come from a sample taken by hash, about 16 rows per range, so equal
    tables have equal ranges whatever their partitions.
    """
    count = rows.count()
    every = max(1, count // (SAMPLES_A_RANGE * n))
    sample = rows.where(F.pmod(F.xxhash64("doc", "h"), F.lit(every)) == 0).collect()
    at = sorted(((r["doc"] is not None, r["doc"] or 0, r["h"]), r["size"]) for r in sample)
    if not at:
        return []
    ends = np.cumsum([size for _, size in at])
    cut = np.searchsorted(ends, ends[-1] * np.arange(1, n) / n, side="left")
    return sorted({at[k][0] for k in cut})


class Shard:
    """One file in memory."""

    def __init__(self, doc_ids: np.ndarray, valid: np.ndarray, counts: np.ndarray, left: np.ndarray, right: np.ndarray, lengths: np.ndarray, symbols: np.ndarray, terminals: int):
        self.doc_ids, self.valid, self.counts = doc_ids, valid, counts
        self.left, self.right, self.lengths, self.symbols, self.terminals = left, right, lengths, symbols, terminals

    @classmethod
    def build(cls, docs: list[tuple[int | None, np.ndarray]], terminals: int) -> Shard:
        counts = np.array([len(x) for _, x in docs], np.int64)
        last = np.zeros(int(counts.sum()), bool)
        last[np.cumsum(counts) - 1] = True
        g = compress(np.concatenate([x for _, x in docs]), last, terminals, LEAST, PER_ROUND, ROUNDS)
        ids, valid = np.array([d or 0 for d, _ in docs], np.int64), np.array([d is not None for d, _ in docs], np.uint8)
        return cls(ids, valid, counts, g.left, g.right, g.lengths(), g.symbols, terminals)

    def to_bytes(self) -> bytes:
        head = HEAD.pack(MAGIC, self.terminals, len(self.left), len(self.symbols), len(self.counts), int(self.counts.sum()))
        parts = [(self.left, "<u4"), (self.right, "<u4"), (self.lengths, "<u4"), (self.symbols, "<u4" if self.terminals + len(self.left) > 65_536 else "<u2"), (self.doc_ids, "<i8"), (self.valid, "u1"), (self.counts, "<u8")]
        return head + b"".join(a.astype(t).tobytes() for a, t in parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        magic, terminals, rules, symbols, documents, ids = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        at, found = HEAD.size, []
        for n, t in ((rules, "<u4"), (rules, "<u4"), (rules, "<u4"), (symbols, "<u4" if terminals + rules > 65_536 else "<u2"), (documents, "<i8"), (documents, "u1"), (documents, "<u8")):
            found.append(np.frombuffer(data, t, n, at))
            at += n * np.dtype(t).itemsize
        left, right, lengths, body, doc_ids, valid, counts = found
        if at != len(data) or int(counts.sum()) != ids:
            raise ValueError("a file of token ids is cut or changed")
        return cls(doc_ids, valid, counts.astype(np.int64), left.astype(np.int64), right.astype(np.int64), lengths.astype(np.int64), body.astype(np.int64), terminals)

    def expander(self) -> Expander:
        return Expander(self.terminals, self.left, self.right, self.lengths)

    def ids(self, start: int, stop: int, expander: Expander | None = None) -> np.ndarray:
        """The ids from ``start`` up to ``stop`` of the shard; only the symbols over them are expanded."""
        ends = np.cumsum(symbol_lengths(self.symbols, self.terminals, self.lengths))
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
        before = int(ends[a - 1]) if a else 0
        return (expander or self.expander()).ids(self.symbols[a:b])[start - before : stop - before]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Each document's id and ids; documents are expanded in groups."""
        expander, ends = self.expander(), np.cumsum(self.counts)
        sizes = np.cumsum(symbol_lengths(self.symbols, self.terminals, self.lengths))
        stops = np.searchsorted(sizes, ends) + 1  # no symbol crosses the end of a document
        k = 0
        while k < len(ends):
            upto = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + (1 << 19), side="right")))
            ids, base = expander.ids(self.symbols[stops[k - 1] if k else 0 : stops[upto - 1]]), ends[k - 1] if k else 0
            for d in range(k, upto):
                yield (int(self.doc_ids[d]) if self.valid[d] else None), ids[ends[d] - self.counts[d] - base : ends[d] - base]
            k = upto


def write_ids(docs: DataFrame, folder: str, model: bytes, key: str = "doc_id", text: str = "text", end: int = 0, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes ``docs`` with the tokenizer file ``model`` and writes shards under ``folder``; returns the manifest, one row per file.

    Each text's ids are followed by ``end``; a null or empty text has only that.
    Documents lie in ascending order of ``key`` (null ids first; rows that share an
    id by a hash of their text), in files by range of that order and number within it. Repeated rows are
    documents of their own. Other columns are not written. An empty table gives an
    empty manifest. A file closes at ``shard_ids`` ids or at the end of its range; the longest
    document and one shard are all that a task holds.
    """
    spark, size = docs.sparkSession, vocabulary_size(model)
    dtype = np.dtype("<u2" if size <= 65_536 else "<u4")
    kind, tail = dtype.str, np.array([end], dtype)
    body = docs[text].cast("string")
    rows = docs.select(docs[key].cast("bigint").alias("doc"), F.xxhash64(body).alias("h"), body.alias("text"))
    n = RANGES_A_PARTITION * shuffle_size(spark)
    bounds = range_bounds(rows.select("doc", "h", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("size")), n)

    def encode(batches):
        known = encoder(model, kind)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [np.concatenate([x, tail]).tobytes() for x in known.encode(part.column("text"))]
                places = [bisect_right(bounds, (d is not None, d or 0, h)) for d, h in zip(part.column("doc").to_pylist(), part.column("h").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), part.column("doc"), part.column("h"), pa.array(ids, pa.binary())], schema=ENCODED)

    def write(batches):
        filesystem, root = _open(folder)
        filesystem.create_dir(f"{root}/data", recursive=True)
        held, count, here, number = [], 0, None, 0

        def close() -> pa.RecordBatch:
            shard = Shard.build(held, size)
            data = shard.to_bytes()
            name = f"data/part-{here:06d}-{number:05d}-{uuid.uuid4().hex}.ids"
            with filesystem.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(data)
            return record_batch(
                FILES, file=[name], range=[here], number=[number], bytes=[len(data)], documents=[len(held)], ids=[count], symbols=[len(shard.symbols)], rules=[len(shard.left)],
                sha256=[hashlib.sha256(data).hexdigest()],
            )

        for batch in batches:
            for place, doc, ids in zip(batch.column("range").to_pylist(), batch.column("doc").to_pylist(), batch.column("ids"), strict=True):
                if held and (place != here or count >= shard_ids):
                    yield close()
                    held, count, number = [], 0, number + 1
                if place != here:
                    here, number = place, 0
                held.append((doc, np.frombuffer(ids.as_buffer(), dtype).copy()))
                count += len(held[-1][1])
        if held:
            yield close()

    dealt = rows.mapInArrow(encode, spark_schema(ENCODED)).repartition(shuffle_size(spark), "range")
    ordered = dealt.sortWithinPartitions("range", F.col("doc").asc_nulls_first(), "h").select("range", "doc", "ids")
    manifest = f"{folder}/manifest"
    ordered.mapInArrow(write, spark_schema(FILES)).write.parquet(manifest)
    return spark.read.parquet(manifest)


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``, the number of ids in all files before each."""
    numbered = number_rows(manifest, [F.col("range").asc(), F.col("number").asc()], position="__place", running={"__upto": "ids"})
    return numbered.withColumn("start", F.col("__upto") - F.col("ids")).drop("__place", "__upto")


def read_shard(folder: str, file: str, size: int, sha: str) -> Shard:
    filesystem, root = _open(folder)
    with filesystem.open_input_stream(f"{root}/{file}", compression=None) as stream:
        data = stream.read()
    if len(data) != size or hashlib.sha256(data).hexdigest() != sha:
        raise ValueError(f"{file} is not the file that the manifest names")
    return Shard.from_bytes(data)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files that the manifest names: ``doc_id``, ``start`` (ids of all documents before it), ``ids`` (little-endian unsigned 32-bit integers) and ``file``.

    A file left by a failed attempt is not read; a missing or changed one raises.
    """
    files = with_starts(spark.read.parquet(f"{folder}/manifest")).select("file", "bytes", "sha256", "start").repartition(shuffle_size(spark), "file")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                start, rows, held = row["start"], [], 0
                for doc, ids in read_shard(folder, row["file"], row["bytes"], row["sha256"]).documents():
                    rows.append((doc, start, ids.astype("<u4").tobytes(), row["file"]))
                    start, held = start + len(ids), held + len(ids)
                    if held > 1 << 20:
                        yield record_batch(DOCUMENTS, **dict(zip(DOCUMENTS.names, map(list, zip(*rows, strict=True)), strict=True)))
                        rows, held = [], 0
                if rows:
                    yield record_batch(DOCUMENTS, **dict(zip(DOCUMENTS.names, map(list, zip(*rows, strict=True)), strict=True)))

    return files.mapInArrow(run, spark_schema(DOCUMENTS))


def ids_between(spark: SparkSession, folder: str, start: int, stop: int) -> np.ndarray:
    """The ids from ``start`` up to ``stop`` of the whole collection, for a run that fits the driver; only the files over it are opened."""
    files = with_starts(spark.read.parquet(f"{folder}/manifest")).where((F.col("start") < stop) & (F.col("start") + F.col("ids") > start)).orderBy("start").collect()
    parts = [read_shard(folder, r["file"], r["bytes"], r["sha256"]).ids(max(0, start - r["start"]), min(r["ids"], stop - r["start"])) for r in files]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)
