"""SentencePiece encoding and decoding as a max-plus scan.

The best segmentation of a text maximises the sum of its piece scores. A text is
a chain of units between which no piece can stand, so units are solved once and
remembered. A giant text is cut into chunks at fixed places, whatever stands
there. A piece may reach over a cut by less than the longest piece, so a chunk
is a max-plus matrix from entry offsets to exit offsets. The matrices of one text
meet in one task, where a vector goes through them from the first to the last and
back, a serial scan that gives every chunk its entry and exit; each chunk is then
traced back on its own. ``combine`` and ``scan_all`` show that the matrices combine
associatively; the query does not use them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenor.llm.grammar import ragged
from provenor.llm.packing import record_batch, shuffle_size, spark_schema
from provenor.llm.words import U, range_hash, slices, text_bytes
from provenor.session import materialise

CHUNK_CHARS = 16_384
ROWS_BYTES = 1 << 20
MANY_LENGTH = 24
REMEMBERED, REMEMBERED_IDS = 1 << 19, 1 << 21
FEW = 32
DECODED_IDS = 1 << 18
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
LOWEST = -np.inf
_SIGN = np.frombuffer(SPACE.encode(), np.uint8)

CHUNKS = pa.schema([("doc", pa.int64()), ("chunk", pa.int64()), ("n", pa.int32()), ("body", pa.string())])
MATRICES = pa.schema([("doc", pa.int64()), ("chunk", pa.int64()), ("matrix", pa.binary())])
STATES = pa.schema([("doc", pa.int64()), ("chunk", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32())])
TRACED = pa.schema([("doc", pa.int64()), ("chunk", pa.int64()), ("ids", pa.binary())])


class Numbers:
    """Distinct 64-bit keys with numbers from 0, set and found many at once: linear probing in a table at most half full."""

    def __init__(self, most: int):
        bits = (2 * most - 1).bit_length()
        self.shift, self.mask = U(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, U), np.full(1 << bits, -1, np.int32)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys * U(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it has none."""
        at = self._place(keys)
        found = self.values[at]
        other = np.flatnonzero((self.keys[at] != keys) & (found >= 0))
        while len(other):
            at[other] = (at[other] + 1) & self.mask
            found[other] = self.values[at[other]]
            other = other[(self.keys[at[other]] != keys[other]) & (found[other] >= 0)]
        return found

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that are not there; no value occurs twice."""
        at, left = self._place(keys), np.arange(len(keys))
        while len(left):
            free = left[self.values[at[left]] < 0]
            self.keys[at[free]], self.values[at[free]] = keys[free], values[free]
            left = left[self.values[at[left]] != values[left]]
            at[left] = (at[left] + 1) & self.mask


class Vocabulary:
    """Pieces with scores, from a SentencePiece model file. Unknown characters become their UTF-8 bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        every = range(sp.GetPieceSize())
        self.byte_ids = {sp.IdToPiece(i): i for i in every if sp.IsByte(i)}
        special = {i for i in every if sp.IsByte(i) or sp.IsControl(i) or sp.IsUnknown(i) or sp.IsUnused(i)}
        self.pieces = {sp.IdToPiece(i): (i, sp.GetScore(i)) for i in every if i not in special}
        self.longest = max(map(len, self.pieces))
        self.prefixes = {p[:n] for p in self.pieces for n in range(1, len(p) + 1)}
        self.unknown = min(score for _, score in self.pieces.values()) - UNKNOWN_PENALTY
        self.texts = [sp.IdToPiece(i) for i in every]
        self.values = [int(t[3:5], 16) if i in special and sp.IsByte(i) else None for i, t in enumerate(self.texts)]
        # a byte below 128 is a character of its own
        self.is_high = np.array([v is not None and v > 127 for v in self.values])
        self.texts = [t if v is None or v > 127 else chr(v) for t, v in zip(self.texts, self.values, strict=True)]
        # units may only be parted where no piece can stand
        spaces_lead = all(SPACE not in p.lstrip(SPACE) for p in self.pieces)
        breaks_alone = all("\n" not in p or len(p) == 1 for p in self.pieces)
        self.unit = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+" if spaces_lead and breaks_alone else "(?s).+")
        self.piece_scores = np.array([sp.GetScore(i) if i not in special else 0.0 for i in every])
        self.chars = np.array([len(t) if v is None else 0 for t, v in zip(self.texts, self.values, strict=True)], np.int64)
        written = [t.replace(SPACE, " ").encode() if v is None else bytes([v]) for t, v in zip(self.texts, self.values, strict=True)]
        self.written, self.written_size = np.frombuffer(b"".join(written), np.uint8), np.array(list(map(len, written)), np.int64)
        self.written_at = np.cumsum(self.written_size) - self.written_size
        self._number_trie()
        self._forget(REMEMBERED, REMEMBERED_IDS)

    def _forget(self, units: int, ids: int) -> None:
        """Room for so many units with so many ids, none of them known."""
        self.numbers, self.count, self.used = Numbers(units), 0, 0
        self.begin, self.size, self.pool = np.zeros(units, np.int64), np.zeros(units, np.int32), np.zeros(ids, np.int32)

    def _number_trie(self) -> None:
        """The pieces as a trie of numbers, for solving many units at once."""
        chars = sorted({c for p in self.pieces for c in p})
        self.char_ids = np.zeros(0x110000, np.uint16)
        self.char_ids[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        states = {prefix: i for i, prefix in enumerate(sorted(self.prefixes), 1)}
        key = lambda prefix: states.get(prefix[:-1], 0) * 65_536 + int(self.char_ids[ord(prefix[-1])])
        self.steps = Numbers(len(states))
        self.steps.put(np.array([key(prefix) for prefix in states], U), np.array(list(states.values()), np.int32))
        self.state_piece, self.state_score = np.full(len(states) + 1, -1, np.int32), np.full(len(states) + 1, LOWEST)
        for piece, (i, score) in self.pieces.items():
            self.state_piece[states[piece]], self.state_score[states[piece]] = i, score

    def solve(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Segmentations of units of at most ``MANY_LENGTH`` characters, all of them place by place: a row of ids, right-aligned, and their number.

        Units with unknown characters are left to ``encode_unit`` and have none.
        """
        codes = np.array(units, f"U{MANY_LENGTH}").view(np.uint32).reshape(len(units), MANY_LENGTH)
        chars, length = self.char_ids[codes], (codes != 0).sum(axis=1)
        known = np.flatnonzero(((chars != 0).sum(axis=1) == length) & (length == [len(u) for u in units]))
        chars, length = np.ascontiguousarray(chars[known].T.astype(U)), length[known]
        best = np.full((MANY_LENGTH + 1, len(known)), LOWEST)
        best[0] = 0.0
        back, piece = np.zeros(best.shape, np.int8), np.zeros(best.shape, np.int32)
        for at in range(int(length.max(initial=0))):
            row = np.flatnonzero((length > at) & (best[at] > LOWEST))
            state = np.zeros(len(row), np.int32)
            for end in range(at + 1, min(at + self.longest, MANY_LENGTH) + 1):
                state = self.steps.get(state.astype(U) * U(65_536) + chars[end - 1][row])
                alive = np.flatnonzero(state >= 0)
                row, state = row[alive], state[alive]
                if not len(row):
                    break
                score = best[at][row] + self.state_score[state]
                better = np.flatnonzero(score > best[end][row])
                to = row[better]
                best[end][to], back[end][to], piece[end][to] = score[better], at, self.state_piece[state[better]]
        place, row = length.copy(), np.arange(len(known))
        trace = np.zeros((len(units), MANY_LENGTH), np.int32)
        count = np.zeros(len(units), np.int64)
        row = row[best[length, row] > LOWEST]
        while len(row := row[place[row] > 0]):
            to = known[row]
            trace[to, MANY_LENGTH - 1 - count[to]] = piece[place[row], row]
            count[to] += 1
            place[row] = back[place[row], row]
        return trace, count

    def segment(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units one after the other, and how many each has."""
        sizes, parts = np.zeros(len(units), np.int64), []
        for at in range(0, len(units), 20_000):
            own = units[at : at + 20_000]
            short = [k for k, u in enumerate(own) if len(u) <= MANY_LENGTH] if len(own) > FEW else []
            trace, count = self.solve([own[k] for k in short])
            if len(short) == len(own) and count.all():
                parts.append(trace[np.arange(MANY_LENGTH) >= MANY_LENGTH - count[:, None]])
                sizes[at : at + len(own)] = count
                continue
            solved = {k: trace[j, MANY_LENGTH - n :] for j, (k, n) in enumerate(zip(short, count.tolist(), strict=True)) if n}
            found = [solved[k] if k in solved else np.array(self.encode_unit(u), np.int32) for k, u in enumerate(own)]
            parts += found
            sizes[at : at + len(own)] = [len(x) for x in found]
        return np.concatenate([np.zeros(0, np.int32), *parts]), sizes

    def edges(self, text: str, at: int, limit: int) -> Iterator[tuple[int, float, int | None]]:
        """Pieces that start at ``at``: their end, score and id; an unknown character has none."""
        if text[at] not in self.pieces:
            yield at + 1, self.unknown, None
        for end in range(at + 1, min(at + self.longest, limit) + 1):
            part = text[at:end]
            if part not in self.prefixes:
                return
            found = self.pieces.get(part)
            if found:
                yield end, found[1], found[0]

    def forward(self, text: str, start: dict[int, float], stop: int) -> tuple[list[float], list[int]]:
        """Best score to each place from the given places, starting pieces before ``stop`` only, and where the last piece began.

        Of equal scores the piece that begins first wins.
        """
        best, back = [LOWEST] * (len(text) + 1), [-1] * (len(text) + 1)
        for at, score in start.items():
            best[at] = score
        for at in range(stop):
            base = best[at]
            if base > LOWEST:
                for end, score, _ in self.edges(text, at, len(text)):
                    if base + score > best[end]:
                        best[end], back[end] = base + score, at
        return best, back

    def score(self, ids: np.ndarray, text: str) -> float:
        """The sum of the scores of the pieces that make up ``text``; unknown characters stand in for their bytes."""
        return float(self.piece_scores[ids].sum()) + self.unknown * (len(text) - int(self.chars[ids].sum()))

    def rest(self, text: str, stop: int) -> list[float]:
        """The best score from each place to ``stop``."""
        out = [LOWEST] * stop + [0.0]
        for at in range(stop - 1, -1, -1):
            out[at] = max(score + out[end] for end, score, _ in self.edges(text, at, stop))
        return out

    def ids_between(self, text: str, a: int, b: int) -> list[int]:
        found = self.pieces.get(text[a:b])
        if found:
            return [found[0]]
        return [self.byte_ids[f"<0x{v:02X}>"] for v in text[a:b].encode("utf-8")]

    def trace(self, text: str, back: list[int], entry: int, end: int) -> list[int]:
        cuts = [end]
        while cuts[-1] > entry:
            cuts.append(back[cuts[-1]])
        out: list[int] = []
        for a, b in zip(cuts[:0:-1], cuts[-2::-1], strict=True):
            out += self.ids_between(text, a, b)
        return out

    def encode_unit(self, unit: str) -> list[int]:
        n, get, prefixes = len(unit), self.pieces.get, self.prefixes
        best, back = [0.0, *[LOWEST] * n], [0] * (n + 1)
        for at in range(n):  # as in ``forward``, for the many short units
            base, end = best[at], at + 1
            if unit[at] not in self.pieces and base + self.unknown > best[end]:
                best[end], back[end] = base + self.unknown, at
            while end <= n and (part := unit[at:end]) in prefixes:
                found = get(part)
                if found and base + found[1] > best[end]:
                    best[end], back[end] = base + found[1], at
                end += 1
        return self.trace(unit, back, 0, n)

    def unit_starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The places of UTF-8 texts at which a unit begins, as ``unit`` finds them."""
        cut = np.zeros(len(data) + 1, bool)
        if self.unit.pattern != "(?s).+":
            line = data == 10
            cut[1:-1] = line[1:] != line[:-1]
            sign = np.flatnonzero(data == _SIGN[0])
            sign = sign[(data[sign + 1] == _SIGN[1]) & (data[sign + 2] == _SIGN[2])]
            cut[sign[np.diff(sign, prepend=-3) != len(_SIGN)]] = True
        cut[offsets] = True
        return np.flatnonzero(cut[:-1])

    def _known(self, names: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The numbers of units; new ones are solved together, and all are forgotten when there is no more room."""
        number = self.numbers.get(names)
        missing = np.flatnonzero(number < 0)
        if not len(missing):
            return number
        new, first = np.unique(names[missing], return_index=True)
        at, whole = missing[first], data.tobytes()
        ids, sizes = self.segment([whole[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
        if self.count + len(new) > len(self.begin) or self.used + len(ids) > len(self.pool):
            if self.count:
                self._forget(REMEMBERED, REMEMBERED_IDS)
                return self._known(names, data, starts, ends)
            self._forget(max(REMEMBERED, len(new)), max(REMEMBERED_IDS, len(ids)))
        to = np.arange(self.count, self.count + len(new))
        self.numbers.put(new, to.astype(np.int32))
        self.begin[to], self.size[to] = self.used + np.cumsum(sizes) - sizes, sizes
        self.pool[self.used : self.used + len(ids)] = ids
        self.count, self.used = self.count + len(new), self.used + len(ids)
        return self.numbers.get(names)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where those of each text begin; a null text has none.

        Units are told apart by 64-bit hashes.
        """
        data, offsets = text_bytes(texts)
        starts = self.unit_starts(data, offsets)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        number = self._known(range_hash(data, starts, ends), data, starts, ends)
        sizes = self.size[number].astype(np.int64)
        ids = self.pool[ragged(self.begin[number], sizes)]
        return ids, np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, offsets)]

    def encode(self, escaped: str) -> np.ndarray:
        return self.encode_all(pa.array([escaped], pa.string()))[0]

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of runs of ids, each up to its end."""
        sizes = self.written_size[ids]
        data = self.written[ragged(self.written_at[ids], sizes)]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        offsets = upto[np.concatenate([[0], ends])]
        keep = np.ones(len(data), bool)
        first = offsets[:-1][np.diff(offsets) > 0]
        keep[first[data[first] == 32]] = False  # the space before the text
        high = np.flatnonzero(self.is_high[ids])
        mended: dict[int, str] = {}
        for k in np.unique(np.searchsorted(ends, high, side="right")).tolist():
            a, b = ends[k - 1] if k else 0, ends[k]
            mended[k] = self.decode(ids[a:b])
            keep[offsets[k] : offsets[k + 1]] = False
        left = np.concatenate([[0], np.cumsum(keep)])[offsets].astype(np.int64)
        out = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(left.tobytes()), pa.py_buffer(data[keep].tobytes())).cast(pa.string())
        if not mended:
            return out
        return pa.array([mended.get(k, t) for k, t in enumerate(out.to_pylist())], pa.string())

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; adjacent bytes join, and bytes that are no text become U+FFFD."""
        if not self.is_high[ids].any():
            return "".join(map(self.texts.__getitem__, ids.tolist())).replace(SPACE, " ").removeprefix(" ")
        parts, held = [], bytearray()
        for i in ids.tolist():
            value = self.values[i]
            if value is not None:
                held.append(value)
                continue
            if held:
                parts.append(held.decode("utf-8", "replace"))
                held = bytearray()
            parts.append(self.texts[i])
        if held:
            parts.append(held.decode("utf-8", "replace"))
        return "".join(parts).replace(SPACE, " ").removeprefix(" ")

    def matrix(self, text: str, n: int) -> np.ndarray:
        """Best scores from each entry offset to each exit offset of a chunk of ``n`` characters; ``text`` reaches past it by a piece.

        Between the first and the last place that every path meets, one run serves all entries.
        """
        size = self.longest
        out = np.full((size, size), LOWEST)
        meet = self.meeting(text, n)
        if meet is None:
            for i in range(size):
                if i < n:
                    best, _ = self.forward(text, {i: 0.0}, n)
                    out[i, : len(text) - n + 1] = [best[n + j] if j < size else LOWEST for j in range(len(text) - n + 1)][:size]
                else:
                    out[i, i - n] = 0.0  # the entry lies beyond a short chunk
            return out
        last = meet + self.tail(text[meet:n])  # up to here units are solved as everywhere
        middle = self.score(self.encode(text[meet:last]), text[meet:last])
        tail, _ = self.forward(text[last:], {0: 0.0}, n - last)
        ahead = np.full(size, LOWEST)
        reach = min(size, len(text) - n + 1)
        ahead[:reach] = [middle + x for x in tail[n - last : n - last + reach]]
        head = self.rest(text, meet)
        for i in range(min(size, meet + 1)):
            out[i] = head[i] + ahead
        return out

    def tail(self, text: str) -> int:
        """The last place in ``text`` that no piece spans, or its start."""
        for at in range(len(text) - 1, 0, -1):
            if self._apart(text[at - 1], text[at]):
                return at
        return 0

    def meeting(self, text: str, n: int) -> int | None:
        """A place before the chunk's end, and beyond every entry offset, that no piece spans."""
        for found in self.unit.finditer(text, min(self.longest, len(text))):
            at = found.start()
            if at >= n:
                return None
            if at > self.longest and self._apart(text[at - 1], text[at]):
                return at
        return None

    def _apart(self, a: str, b: str) -> bool:
        return self.unit.pattern != "(?s).+" and ((b == SPACE and a != SPACE) or (a == "\n") != (b == "\n"))


@lru_cache(maxsize=2)
def vocabulary_of(model: bytes) -> Vocabulary:
    """The vocabulary and its solved units, shared by the tasks of a worker process."""
    return Vocabulary(model)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return np.max(a[:, :, None] + b[None, :, :], axis=1)


def entries_and_exits(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """For each chunk the offsets of the best path through all of them."""
    reach = [np.where(np.arange(len(matrices[0])) == 0, 0.0, LOWEST)]
    for m in matrices:
        reach.append(np.max(reach[-1][:, None] + m, axis=0))
    leave, out = 0, []
    for before, m in zip(reach[-2::-1], matrices[::-1], strict=True):
        entry = int(np.argmax(before + m[:, leave]))
        out.append((entry, leave))
        leave = entry
    return out[::-1]


def _lists(found: list) -> pa.ListArray:
    """Lists of ids as one column; None stays null."""
    sizes = np.array([0 if x is None else len(x) for x in found], np.int64)
    flat = np.concatenate([np.zeros(0, np.int32), *(np.array(x, np.int32) for x in found if x is not None)])
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    empty = pa.array([x is None for x in found], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=empty)


def _giants(giants: DataFrame, model: bytes, chunk: int) -> DataFrame:
    """``doc`` and its chunks' ids in order, for texts longer than a chunk."""
    spark = giants.sparkSession
    parts = shuffle_size(spark)

    def cut(batches):
        longest = vocabulary_of(model).longest
        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("body").to_pylist(), strict=True):
                for k, at in enumerate(range(0, len(text), chunk)):
                    n = min(chunk, len(text) - at)
                    yield record_batch(CHUNKS, doc=[doc], chunk=[k], n=[n], body=[text[at : at + n + longest - 1]])

    chunks = materialise(giants.mapInArrow(cut, spark_schema(CHUNKS)).repartition(parts, "doc", "chunk"), "chunks")

    def to_matrix(batches):
        vocabulary = vocabulary_of(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                vocabulary.encode_all(part.column("body"))  # from here on its units are known
                found = [vocabulary.matrix(t, n).tobytes() for t, n in zip(part.column("body").to_pylist(), part.column("n").to_pylist(), strict=True)]
                yield record_batch(MATRICES, doc=part.column("doc"), chunk=part.column("chunk"), matrix=found)

    def scan(batches):
        waiting: tuple[int, list, list] | None = None

        def closed(doc, numbers, found):
            size = int(np.sqrt(len(found[0]) // 8))
            states = entries_and_exits([np.frombuffer(m).reshape(size, size) for m in found])
            return record_batch(STATES, doc=[doc] * len(numbers), chunk=numbers, entry=[e for e, _ in states], leave=[x for _, x in states])

        for batch in batches:
            for doc, number, found in zip(*(batch.column(c).to_pylist() for c in ("doc", "chunk", "matrix")), strict=True):
                if waiting and waiting[0] != doc:
                    yield closed(*waiting)
                    waiting = None
                waiting = waiting or (doc, [], [])
                waiting[1].append(number)
                waiting[2].append(found)
        if waiting:
            yield closed(*waiting)

    matrices = chunks.mapInArrow(to_matrix, spark_schema(MATRICES)).repartition(parts, "doc").sortWithinPartitions("doc", "chunk")
    states = matrices.mapInArrow(scan, spark_schema(STATES))

    def trace(batches):
        vocabulary = vocabulary_of(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, out = batch.slice(at, 64), []
                rows = list(zip(*(part.column(c).to_pylist() for c in ("body", "n", "entry", "leave")), strict=True))
                vocabulary.encode_all(part.column("body"))
                for text, n, entry, leave in rows:
                    meet = vocabulary.meeting(text, n)
                    if entry >= n + leave:  # a piece from before reaches over the whole chunk
                        ids = []
                    elif meet is None:
                        _, back = vocabulary.forward(text, {entry: 0.0}, n)
                        ids = vocabulary.trace(text, back, entry, n + leave)
                    else:
                        ids = np.concatenate([vocabulary.encode(text[entry:meet]), vocabulary.encode(text[meet : n + leave])])
                    out.append(np.array(ids, np.int32).tobytes())
                yield record_batch(TRACED, doc=part.column("doc"), chunk=part.column("chunk"), ids=out)

    traced = chunks.join(states, ["doc", "chunk"]).select("doc", "chunk", "n", "body", "entry", "leave").mapInArrow(trace, spark_schema(TRACED))
    return traced.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("pieces"))


def encode(df: DataFrame, model: bytes, text: str = "text", ids: str = "ids", chunk: int = CHUNK_CHARS, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of ``df`` with ``ids``, the piece ids of the whole text (array of int).

    ``keep`` lists the columns of ``df`` to return (all by default); what it leaves out is not sent to the tasks.
    Spaces are written U+2581, one more stands before the text, and nothing else
    is normalised, so ``decode`` gives the text back; a U+2581 in a text comes back as a space. A null text has null
    ids, an empty one none. Rows that repeat are encoded alike; an empty table
    gives an empty one; a column of ``df`` named ``ids`` gives way. Texts longer
    than ``chunk`` characters go through the chunk scan, all others are solved where
    they are. Within a chunk without any place that all segmentations share,
    segmentations of equal score may be told apart otherwise than in one piece.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c != ids]
    rows = df.select(*(F.col(c).alias(f"__in_{c}") for c in keep), F.when(df[text] == "", "").otherwise(F.concat(F.lit(SPACE), F.replace(df[text], F.lit(" "), F.lit(SPACE)))).alias("body"))
    rows = rows.withColumn("doc", F.when(F.length("body") > chunk, F.xxhash64("body")))
    kept = [f"__in_{c}" for c in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema), "ids array<int>"])

    def solve(batches):
        vocabulary = vocabulary_of(model)
        for batch in batches:
            for part in slices(batch, "body", ROWS_BYTES):
                found, ends = vocabulary.encode_all(part.column("body"))
                found = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found), mask=part.column("body").is_null())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), found], names=[*kept, "ids"])

    short = rows.where("doc is null").select(*kept, "body").mapInArrow(solve, schema)
    long = rows.where("doc is not null")
    traced = _giants(long.select("doc", "body").dropDuplicates(["doc"]), model, chunk)

    def join_up(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                found = [np.frombuffer(b"".join(p["ids"] for p in pieces), np.int32) for pieces in part.column("pieces").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), _lists(found)], names=[*kept, "ids"])

    joined = long.select("doc", *kept).join(traced, "doc").select(*kept, "pieces").mapInArrow(join_up, schema)
    return short.unionByName(joined).select(*(F.col(f"__in_{c}").alias(c) for c in keep), F.col("ids").alias(ids))


def decode(df: DataFrame, model: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """The rows of ``df`` with ``text``, the text of the ids; null ids give null, no ids an empty text."""
    keep = [c for c in df.columns if c != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema), f"`{text}` string"])

    def run(batches):
        vocabulary = vocabulary_of(model)
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(ids)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + DECODED_IDS, side="right")))
                part = batch.slice(at, stop - at)
                found = vocabulary.decode_all(part.column(ids).flatten().to_numpy(), ends[at:stop] - (ends[at - 1] if at else 0))
                found = pc.if_else(part.column(ids).is_null(), pa.scalar(None, pa.string()), found)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), found], names=[*keep, text])
                at = stop

    return df.select(*keep).mapInArrow(run, schema)


def scan_all(matrices: list[np.ndarray]) -> np.ndarray:
    """The matrix of all chunks together."""
    return reduce(combine, matrices)
