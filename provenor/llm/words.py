"""Whole texts as byte arrays: words, their hashes and where they stand.

A word is a run of bytes other than space and 0x09-0x0D. All functions work on
one Arrow slice at a time; ``slices`` bounds its bytes, so memory follows the
slice and the longest single text, never the partition. Hashes are summed block by
block within a slice: they take 8 bytes for each byte or word of a block, not of the slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 4 << 20
#: Enough for one pass over words whose results do not depend on the slice.
HASHED_BYTES = 1 << 20
BLOCK = 1 << 18
_RADIX, _RADIX_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_BYTE_CODES = mix(np.arange(1, 257, dtype=U) * U(_RADIX))
_LOWER = np.arange(256)
_LOWER[65:91] += 32


def _powers(radix: int, n: int) -> np.ndarray:
    have = _POWERS.get(radix)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK + 1), radix, U)
        steps[0] = 1
        have = np.cumprod(steps, dtype=U)
        if n <= 2 * BLOCK:  # those of an exceptionally long word or run do not stay in memory
            _POWERS[radix] = have
    return have[:n]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of at most ``limit`` text bytes, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of texts and where each text begins; a null text is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def range_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, codes: np.ndarray = _BYTE_CODES) -> np.ndarray:
    """A hash of the bytes from each start up to its end; neither starts nor ends may fall.

    It does not depend on where a range stands, so ranges are taken block by block.
    """
    h, at = np.empty(len(start), U), 0
    while at < len(start):
        low = start[at]
        stop = max(at + 1, int(np.searchsorted(end, low + BLOCK, side="right")))
        n = int(end[stop - 1] - low)
        sums = np.concatenate([[U(0)], np.cumsum(codes[data[low : low + n]] * _powers(_RADIX, n), dtype=U)])
        begin = start[at:stop] - low
        h[at:stop] = mix((sums[end[at:stop] - low] - sums[begin]) * _powers(_RADIX_INVERSE, n + 1)[begin] + (end[at:stop] - start[at:stop]).astype(U) * U(_RADIX))
        at = stop
    return h


class Words:
    """The words of a column of texts; a null text has none.

    ``first[d]:first[d + 1]`` are the words of text ``d``, ``start`` and ``end``
    their byte places in ``data``, ``hash`` their 64-bit values.
    """

    def __init__(self, texts: pa.Array, lower: bool):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.offsets = offsets = offsets - offsets[0]
        self.data = data
        inside = ~_IS_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        self.start = np.flatnonzero(inside & (edge[:-1] | np.concatenate([[True], ~inside[:-1]])))
        self.end = np.flatnonzero(inside & (edge[1:] | np.concatenate([~inside[1:], [True]]))) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = range_hash(data, self.start, self.end, _BYTE_CODES[_LOWER] if lower else _BYTE_CODES)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def text(self, d: int) -> bytes:
        return self.data[self.offsets[d] : self.offsets[d + 1]].tobytes()


def run_hash(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive values: one for every place at which a run of that length starts."""
    count = len(h) - n + 1
    if count <= 0:
        return np.zeros(0, U)
    runs, step = np.empty(count, U), max(BLOCK, n)
    for at in range(0, count, step):
        part = h[at : at + step + n - 1]
        sums = np.concatenate([[U(0)], np.cumsum(part * _powers(_RADIX, len(part)), dtype=U)])
        here = len(part) - n + 1
        runs[at : at + here] = mix((sums[n:] - sums[:here]) * _powers(_RADIX_INVERSE, len(part))[:here])
    return runs


def shingle_sets(words: Words, n: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``n``-word runs of each text; fewer words count as one run."""
    runs, first, h = run_hash(words.hash, n), words.first, words.hash
    sets = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            sets.append(np.unique(runs[a : b - n + 1]))
        elif b > a:
            sets.append(mix(run_hash(h[a:b], int(b - a)) + U(b - a)))
        else:
            sets.append(np.zeros(0, U))
    return sets
