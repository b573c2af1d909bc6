"""Benchmark decontamination by latent semantic retrieval.

Passages are TF-IDF vectors over hashed terms. A distributed randomised SVD of
all benchmark items and corpus passages, in one pass over the corpus, gives a
small latent space; every window of every document is projected there and compared with the items by cosine. Beside
it, an exact search looks up the rarest words of each item: no window can hold
enough of an item without some of them. What either finds is checked word by
word: the longest common subsequence with the item, and with its answer. So
what is found does not depend on the cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenor.llm.packing import deal, record_batch, spark_schema
from provenor.llm.words import U, Words, slices
from provenor.session import materialise

TERMS = 1 << 14
RANK = 128
OVERSAMPLE = 8
BLOCK = 16
SHORT, LONG = 3, 6  # blocks per window; short windows hold items of up to 32 words, long ones of up to 64
ITEM_WORDS = 64
MIN_COSINE = 0.5
MIN_LCS = 0.6
MIN_ANSWER = 0.5
ANSWER_WORDS = 8
RARE_WORDS = 3
RANGE_BLOCKS = 1024
ITEM_BLOCK = 4096
RANGES = 16
CHUNK = 1 << 12
ROWS = 1 << 12
COUNT_ROWS = 128
PIECE = 64
TEXT_BYTES, TERM_BYTES = 1 << 19, 1 << 20

DENSE = pa.schema([("part", pa.int32()), ("data", pa.binary())])
HITS = pa.schema([
    ("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.int64()), ("item_words", pa.int64()), ("answer_lcs", pa.int64()),
    ("start_word", pa.int64()),
])


def terms(words: Words) -> np.ndarray:
    return (words.hash & U(TERMS - 1)).astype(np.int64)


def _ranges(data: np.ndarray) -> pa.RecordBatch:
    pieces = np.split(data, RANGES)
    return record_batch(DENSE, part=list(range(RANGES)), data=[p.tobytes() for p in pieces])


def summed_dense(partial: DataFrame, kind, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of arrays of a fixed shape, added up by ranges of rows on the executors."""
    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                data = np.frombuffer(row["data"], kind)
                sums[row["part"]] = sums[row["part"]] + data if row["part"] in sums else data
        for part, data in sums.items():
            yield record_batch(DENSE, part=[part], data=[data.tobytes()])

    out = np.zeros((RANGES, int(np.prod(shape)) // RANGES), kind)
    for row in deal(partial, RANGES).mapInArrow(add, spark_schema(DENSE)).toLocalIterator():
        out[row["part"]] = np.frombuffer(row["data"], kind)
    return out.reshape(shape)


def texts_with_term(term: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The number of texts that have each term; text ``d`` has the terms ``first[d]:first[d + 1]``."""
    counts = np.zeros(TERMS, np.int64)
    for at in range(0, len(first) - 1, COUNT_ROWS):
        bounds = first[at : at + COUNT_ROWS + 1]
        seen = np.zeros((len(bounds) - 1, TERMS), bool)
        seen[np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), term[bounds[0] : bounds[-1]]] = True
        counts += seen.sum(axis=0, dtype=np.uint8)  # of fewer than 256 texts
    return counts


def stored_terms(docs: DataFrame) -> DataFrame:
    """The terms of each text (``part`` -1), and how many texts of a task have each term by ranges of terms, written in one pass."""
    def run(batches):
        counts = np.zeros(TERMS, np.int64)
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                words = Words(part.column("text"), lower=True)
                term = terms(words)
                counts += texts_with_term(term, words.first)
                ends = pa.py_buffer((2 * words.first).astype(np.int32).tobytes())
                own = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, ends, pa.py_buffer(term.astype(np.uint16).tobytes())])
                yield record_batch(DENSE, part=np.full(part.num_rows, -1), data=own)
        yield _ranges(counts)

    return materialise(docs.select("text").mapInArrow(run, spark_schema(DENSE)), "terms")


def inverse_frequencies(stored: DataFrame, n_texts: int, items: list[np.ndarray]) -> np.ndarray:
    """Inverse document frequency of each hashed term over all documents and items."""
    counts = summed_dense(stored.where("part >= 0"), np.int64, (TERMS,))
    for item in items:
        counts[np.unique(item)] += 1
    n = max(n_texts + len(items), 1)
    return np.maximum(np.log((n + 1) / (counts + 1)), 0.0).astype(np.float32)


def window_starts(counts: np.ndarray, size: int) -> np.ndarray:
    """Where consecutive runs of ``size`` words begin, in texts of so many words that stand one after the other."""
    per = -(-counts // size)
    place = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    return np.repeat(np.cumsum(counts) - counts, per) + place * size


def windows_of(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of consecutive runs of ``size`` words within each text."""
    counts = words.counts()
    per = -(-counts // size)
    owner = np.repeat(np.arange(len(counts)), per)
    place = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    start = words.first[owner] + place * size
    return start, np.minimum(start + size, words.first[owner + 1])


def project(term: np.ndarray, starts: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``space`` over consecutive ranges of ``term``, of one term at least, that begin at ``starts``."""
    out = np.zeros((len(starts), space.shape[1]), np.float32)
    sizes = np.diff(np.append(starts, len(term)))
    for at in range(0, len(starts), ROWS):
        order = at + np.argsort(-sizes[at : at + ROWS], kind="stable")
        begin, size = starts[order], sizes[order]
        total = space[term[begin]]
        for j in range(1, size[0]):
            longer = int(np.searchsorted(-size, -j))
            total[:longer] += space[term[begin[:longer] + j]]
        out[order] = total
    return out


def _gram(term: np.ndarray, starts: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``A' (A basis)`` for unit-length TF-IDF rows A, by sums over the words of a row and then over the places of a term."""
    out = np.zeros((TERMS, basis.shape[1]), np.float32)
    if not len(starts):
        return out
    row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(term))))
    entry, times = np.unique(row * TERMS + term, return_counts=True)
    squares = np.bincount(entry // TERMS, (times * idf[entry % TERMS].astype(float)) ** 2, len(starts))
    image = project(term, starts, idf[:, None] * basis) / np.maximum(squares, 1e-24)[:, None].astype(np.float32)
    order = np.argsort(term.astype(np.uint16), kind="stable")
    sizes = np.bincount(term, minlength=TERMS)
    pieces = -(-sizes // PIECE)  # a frequent term's places are summed piece by piece
    owner = np.repeat(np.arange(TERMS), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    sums = project(row[order], (np.cumsum(sizes) - sizes)[owner] + PIECE * nth, image)
    used = np.flatnonzero(sizes)
    out[used] = np.add.reduceat(sums, (np.cumsum(pieces) - pieces)[used], axis=0) * idf[used, None]
    return out


def start_vectors(rank: int) -> np.ndarray:
    """Random orthonormal vectors (terms x rank and a few more), the same in every run."""
    return np.linalg.qr(np.random.default_rng(20240101).standard_normal((TERMS, rank + OVERSAMPLE), dtype=np.float32))[0]


def corpus_sketch(docs: DataFrame, idf: np.ndarray, start: np.ndarray, stored: DataFrame | None = None) -> np.ndarray:
    """``A' (A start)`` where the rows of A are the windows of all documents, from their ``stored_terms``.

    A task sends one array of the sketch's size, so there are only so many tasks as keep all cores busy.
    """
    context = docs.sparkSession.sparkContext
    sent = context.broadcast((start, idf))
    stored = stored_terms(docs) if stored is None else stored

    def run(batches):
        basis, weights = sent.value
        total = np.zeros(basis.shape, np.float32)
        for batch in batches:
            for part in slices(batch, "data", TERM_BYTES):
                counts = pc.binary_length(part.column("data")).to_numpy().astype(np.int64) // 2
                term = np.frombuffer(b"".join(part.column("data").to_pylist()), np.uint16).astype(np.int64)
                total += _gram(term, window_starts(counts, SHORT * BLOCK), weights, basis)
        yield _ranges(total)

    texts = stored.where("part < 0").coalesce(2 * context.defaultParallelism)
    out = summed_dense(texts.mapInArrow(run, spark_schema(DENSE)), np.float32, start.shape)
    sent.destroy()
    return out


def latent_space(sketch: np.ndarray, start: np.ndarray, items: list[np.ndarray], idf: np.ndarray, weight: float) -> np.ndarray:
    """Right singular vectors (terms x rank) of the items and the windows of all documents, by Nystrom's formula from the sketch of both.

    Items weigh ``weight`` each.
    """
    item_starts = np.cumsum([0, *map(len, items)])[:-1]
    seen = sketch.astype(float) + weight * _gram(np.concatenate(items), item_starts, idf, start)
    shift = 1e-6 * max(float(np.linalg.norm(seen)), 1e-12)
    seen += shift * start
    values, vectors = np.linalg.eigh((start.T @ seen + seen.T @ start) / 2)
    half = seen @ (vectors / np.sqrt(np.maximum(values, shift / 2)))
    left = np.linalg.svd(half, full_matrices=False)[0]
    return left[:, : start.shape[1] - OVERSAMPLE].astype(np.float32)


def lcs(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel; ``masks`` has the places of each word of the item."""
    row = full = (1 << size) - 1
    for w in words:
        u = row & masks.get(w, 0)
        row = (row + u) | (row - u)
    return size - (row & full).bit_count()


def masks_of(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def least_common(size: int) -> int:
    """How many words of an item of ``size`` words have to be found, in order: all of them for an item of fewer words than an answer."""
    return size if size <= ANSWER_WORDS else max(ANSWER_WORDS, math.ceil(MIN_LCS * size))


def found_in(size: int, common: int, answer: int, answer_common: int) -> bool:
    """Enough of the item in order, and enough of its answer."""
    return common >= least_common(size) and answer_common >= MIN_ANSWER * answer


def item_passages(item_ids: list[int], texts: list[str | None], answers: list[str | None]) -> list[tuple]:
    """(item, words, answer words, terms) of each run of at most ``ITEM_WORDS`` words of each item."""
    words, given = Words(pa.array(texts, pa.string()), lower=True), Words(pa.array(answers, pa.string()), lower=True)
    out = []
    for d, item in enumerate(item_ids):
        own = words.hash[words.first[d] : words.first[d + 1]]
        answer = given.hash[given.first[d] : given.first[d + 1]].tolist()
        pieces = np.array_split(own, -(-len(own) // ITEM_WORDS)) if len(own) else []
        for k, p in enumerate(pieces):
            last = answer if answer and k == len(pieces) - 1 else p[-ANSWER_WORDS:].tolist()
            out.append((item, p.tolist(), last, (p & U(TERMS - 1)).astype(np.int64)))
    return out


class RareWords:
    """The rarest words of each passage, of which every window that holds enough of the passage has some.

    A window lacks at most ``size - least_common(size)`` words of a passage, so
    of any that many and k more it has k. These are the rarest, and k is
    ``RARE_WORDS`` where the passage has to share so many.
    """

    def __init__(self, passages: list[tuple], idf: np.ndarray):
        words, owners = [], []
        self.needed = np.zeros(len(passages), np.int64)
        for i, (_, own, _, term) in enumerate(passages):
            size, least = len(own), least_common(len(own))
            self.needed[i] = min(least, RARE_WORDS)
            rarest = np.argsort(-idf[term], kind="stable")[: size - least + self.needed[i]]
            words.append(np.array(own, U)[rarest])
            owners.append(np.full(len(rarest), i))
        word, owner = np.concatenate(words), np.concatenate(owners)
        order = np.lexsort((owner, word))
        word, owner = word[order], owner[order]
        head = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])]))
        self.times, self.owner = np.diff(np.append(head, len(word))), owner[head]
        self.words, self.first = np.unique(word[head], return_index=True)
        self.first = np.append(self.first, len(head))

    def windows(self, hashes: np.ndarray, starts: np.ndarray, owner: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows (by their first block) and passages that share enough rare words; ``spans`` has the blocks of a passage's windows."""
        found = [np.zeros((2, 0), np.int64)]
        edges = np.append(starts, len(hashes))
        for at in range(0, len(starts), RANGE_BLOCKS):
            stop = min(at + RANGE_BLOCKS + LONG - 1, len(starts))
            window, passage = self._windows(hashes[edges[at] : edges[stop]], starts[at:stop] - starts[at], owner[at:stop], spans)
            own = window < RANGE_BLOCKS
            found.append(np.stack([window[own] + at, passage[own]]))
        window, passage = np.concatenate(found, axis=1)
        return window, passage

    def _windows(self, hashes: np.ndarray, starts: np.ndarray, owner: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        place = np.flatnonzero(self.words[at] == hashes)
        at = at[place]
        many = self.first[at + 1] - self.first[at]
        entry = np.repeat(self.first[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
        block = np.repeat(np.searchsorted(starts, place, side="right") - 1, many)
        key, back = np.unique(block * len(spans) + self.owner[entry], return_inverse=True)
        times = np.bincount(back, self.times[entry], len(key))
        block, passage = key // len(spans), key % len(spans)
        span = spans[passage]
        window = np.repeat(block - span + 1, span) + np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
        inside = (window >= 0) & (owner[np.maximum(window, 0)] == np.repeat(owner[block], span))
        key, back = np.unique((window * len(spans) + np.repeat(passage, span))[inside], return_inverse=True)
        enough = key[np.bincount(back, np.repeat(times, span)[inside], len(key)) >= self.needed[key % len(spans)]]
        return enough // len(spans), enough % len(spans)


def search(docs: DataFrame, passages: list[tuple], idf: np.ndarray, space: np.ndarray, min_cosine: float) -> DataFrame:
    """Every document against one block of item passages."""
    spark = docs.sparkSession
    scaled = idf[:, None] * space
    latent = project(np.concatenate([p[3] for p in passages]), np.cumsum([0, *(len(p[3]) for p in passages)])[:-1], scaled)
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    sent = spark.sparkContext.broadcast((scaled, latent, RareWords(passages, idf), [(i, len(w), masks_of(w), len(a), masks_of(a)) for i, w, a, _ in passages]))

    def run(batches):
        weights, targets, rare, items = sent.value
        short = np.array([n <= SHORT * BLOCK - BLOCK for _, n, *_ in items])
        spans = np.where(short, SHORT, LONG)
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                words = Words(part.column("text"), lower=True)
                starts, _ = windows_of(words, BLOCK)
                if not len(starts):
                    continue
                owner = np.searchsorted(words.first, starts, side="right") - 1
                blocks = project(terms(words), starts, weights)
                three = shifted_sum(shifted_sum(blocks, blocks, owner, 1), blocks, owner, 2)
                six = shifted_sum(three, three, owner, SHORT)
                near = [rare.windows(words.hash, starts, owner, spans)]
                for of, vectors in ((np.flatnonzero(short), three), (np.flatnonzero(~short), six)):
                    to = np.ascontiguousarray(targets[of].T)
                    for at in range(0, len(vectors) if len(of) else 0, CHUNK):
                        v = vectors[at : at + CHUNK]
                        length = np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-12)
                        w, i = np.nonzero(v @ to >= min_cosine * length[:, None])
                        near.append((at + w, of[i]))
                best: dict[tuple[int, int], tuple] = {}
                pairs = np.unique(np.concatenate([w * len(items) + i for w, i in near]))
                for w, i in zip((pairs // len(items)).tolist(), (pairs % len(items)).tolist(), strict=True):
                    start = int(starts[w])
                    d, item, size, mask, answer, answer_mask = int(owner[w]), *items[i]
                    text = words.hash[start : min(start + int(spans[i]) * BLOCK, words.first[d + 1])].tolist()
                    if not found_in(size, sum(map(mask.__contains__, text)), 0, 0):
                        continue  # more words than these cannot be common
                    common = lcs(mask, size, text)
                    in_answer = lcs(answer_mask, answer, text)
                    if found_in(size, common, answer, in_answer):
                        v = (three if short[i] else six)[w]
                        place = start - int(words.first[d])
                        hit = (common, float(v @ targets[i] / max(np.linalg.norm(v), 1e-12)), -place, size, in_answer)
                        best[d, item] = max(best.get((d, item), hit), hit)
                ids = part.column("id")
                rows = [(ids[d].as_py(), item, c, n, size, a, -place) for (d, item), (n, c, place, size, a) in best.items()]
                yield record_batch(HITS, **dict(zip(HITS.names, map(list, zip(*rows, strict=True)) if rows else [[]] * len(HITS.names), strict=True)))

    return docs.mapInArrow(run, spark_schema(HITS))


def shifted_sum(a: np.ndarray, b: np.ndarray, owner: np.ndarray, by: int) -> np.ndarray:
    """``a`` plus the rows of ``b`` that stand ``by`` places later in the same text."""
    out = a.copy()
    if len(b) > by:
        out[:-by] += b[by:] * (owner[by:] == owner[:-by])[:, None]
    return out


def _blocks(benchmark: DataFrame, item: str, text: str, answer: str | None, size: int) -> Iterator[list[tuple]]:
    rows: list = []
    for row in benchmark.select(F.col(item).cast("bigint"), text, F.col(answer) if answer else F.lit(None).cast("string")).toLocalIterator():
        rows.append(tuple(row))
        if len(rows) == size:
            yield item_passages(*map(list, zip(*rows, strict=True)))
            rows = []
    if rows:
        yield item_passages(*map(list, zip(*rows, strict=True)))


def contaminated(
    df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", answer: str | None = None,
    rank: int = RANK, min_cosine: float = MIN_COSINE,
) -> DataFrame:
    """One row per document and benchmark item found in it: ``doc_id``, ``item_id``, ``cosine``, ``lcs``, ``item_words``, ``answer_lcs``, ``start_word``.

    An item is found where a window shares, in order, 60 % of its words (all of
    them for items of up to 8 words) and half of its answer; without an
    ``answer`` column the last 8 words count as the answer. Items of more than 64
    words are searched in runs of at most 64; the best run is reported. Every
    window (48 words for items of up to 32 words, 96 for longer ones, one from
    every 16th word) that shares enough is found: the cosine brings further
    candidates, never rules one out. Null and
    empty texts have no passages and find nothing; repeated rows are reported
    each; an empty benchmark or table gives no rows; further columns are not
    read. Items travel to the tasks in blocks of 4096, so the benchmark may have
    any size; document frequencies and the latent space come from all documents.
    """
    spark = df.sparkSession
    docs = df.select(df[key].cast("bigint").alias("id"), df[text].alias("text"))
    out = spark.createDataFrame([], spark_schema(HITS))
    start, sketch, idf, n_windows = start_vectors(rank), None, None, 0.0
    for passages in _blocks(benchmark, item, item_text, answer, ITEM_BLOCK):
        if not passages:
            continue
        if sketch is None:
            stored = stored_terms(docs)
            idf = inverse_frequencies(stored, docs.count(), [p[3] for p in passages])
            sketch = corpus_sketch(docs, idf, start, stored)
            n_windows = docs.select(F.sum(F.greatest(F.lit(1), F.length("text") / 300))).first()[0] or 0.0
        space = latent_space(sketch, start, [p[3] for p in passages], idf, max(1.0, n_windows / len(passages)))
        out = out.unionByName(search(docs, passages, idf, space, min_cosine))
    return out
