"""Periodic runs of words, found in a Re-Pair grammar.

The word ids of a slice of documents become a grammar; what is left of a document is
paired up by place until one symbol stands for it, so every document is the root of a
binary derivation. A run that lies in a symbol and in neither of its halves crosses
the boundary between them. Such runs are computed once per symbol: for every
period the words beside the boundary are compared with those one period away, and
the agreement is extended to both sides by hashes of word runs. Going down from the roots,
the runs of each symbol are moved to all places where it stands. A run that the end of a symbol cut
short is extended by the words beyond and belongs to a symbol further up, so what remains is maximal; of
several periods over the same words the smallest counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenor.llm.grammar import Grammar, compress, ragged, symbol_lengths
from provenor.llm.packing import record_batch, spark_schema
from provenor.llm.words import U, Words, _powers, slices

LEAST_LENGTH = 12
COMPARED = 1 << 21  # pairs of places compared at once
_RADIX = 0x9E3779B97F4A7C15

FOUND = pa.schema([
    ("n_words", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()),
    ("n_collapsed", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string()),
])


class Repeats:
    """How far the words from two places on (or back from them) agree, by hashes of word runs."""

    def __init__(self, codes: np.ndarray):
        self.sums = np.concatenate([[U(0)], np.cumsum(codes * _powers(_RADIX, len(codes)), dtype=U)])
        self.powers = _powers(_RADIX, len(codes) + 1)

    def _equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` words from a and from b (behind a) are the same."""
        return (self.sums[a + size] - self.sums[a]) * self.powers[b - a] == self.sums[b + size] - self.sums[b]

    def agree(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray, back: bool) -> np.ndarray:
        low, high = np.zeros(len(a), np.int64), limit.copy()
        while len(low) and (low < high).any():
            middle = (low + high + 1) // 2
            same = self._equal(a - middle, b - middle, middle) if back else self._equal(a, b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


class Names:
    """The same without hashes: equal stretches of 1, 2, 4, 8 ... words have equal numbers."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.levels = codes, [np.unique(codes, return_inverse=True)[1].astype(U)]

    def _level(self, j: int) -> np.ndarray:
        while len(self.levels) <= j:
            have, width = self.levels[-1], 1 << (len(self.levels) - 1)
            pairs = (have[:-width] << U(32)) | have[width:]
            self.levels.append(np.unique(pairs, return_inverse=True)[1].astype(U))
        return self.levels[j]

    def agree(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray, back: bool) -> np.ndarray:
        done = np.zeros(len(a), np.int64)
        for j in range(int(limit.max(initial=0)).bit_length() - 1, -1, -1):
            width, names = 1 << j, self._level(j)
            room = np.flatnonzero(done + width <= limit)
            shift = -done[room] - width if back else done[room]
            done[room[names[a[room] + shift] == names[b[room] + shift]]] += width
        return done


class Derivation:
    """The grammar with whole documents as roots: halves, lengths and a first place of every rule."""

    def __init__(self, grammar: Grammar, starts: np.ndarray):
        self.terminals = grammar.terminals
        rules = grammar.lengths()
        symbols, last = grammar.symbols, grammar.last
        left, right, lengths, made = [grammar.left], [grammar.right], [rules], len(rules)
        self.levels = [0, *grammar.rounds]
        size = symbol_lengths(symbols, self.terminals, rules)
        while not last.all():  # pair up by place, documents with an odd number keep their last symbol
            first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
            within = np.arange(len(symbols)) - np.repeat(first, np.diff(np.concatenate([first, [len(symbols)]])))
            at = np.flatnonzero((within % 2 == 0) & ~last)
            left.append(symbols[at])
            right.append(symbols[at + 1])
            lengths.append(size[at] + size[at + 1])
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            symbols, size, last = symbols.copy(), size.copy(), last.copy()
            symbols[at], size[at], last[at] = self.terminals + made + np.arange(len(at)), lengths[-1], last[at + 1]
            symbols, size, last = symbols[stay], size[stay], last[stay]
            made += len(at)
            self.levels.append(made)
        self.left, self.right, self.length = np.concatenate(left), np.concatenate(right), np.concatenate(lengths)
        self.roots, self.starts = symbols, starts
        self.place = np.full(made, -1, np.int64)
        self._place(symbols, starts)

    def half(self, rules: np.ndarray) -> np.ndarray:
        return symbol_lengths(self.left[rules], self.terminals, self.length)

    def _place(self, symbols: np.ndarray, at: np.ndarray) -> None:
        """Gives every rule one place where it stands, from the last rules to the first."""
        inner = symbols >= self.terminals
        self.place[symbols[inner] - self.terminals] = at[inner]
        for a, b in zip(self.levels[-2::-1], self.levels[:0:-1], strict=True):
            rules = np.arange(a, b)
            rules = rules[self.place[rules] >= 0]
            cut = self.place[rules] + self.half(rules)
            for side, places in ((self.left[rules], self.place[rules]), (self.right[rules], cut)):
                inner = side >= self.terminals
                self.place[side[inner] - self.terminals] = places[inner]

    def places(self, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rules and all places where they stand, level by level, as far down as a rule in ``wanted`` can be."""
        below = wanted.copy()
        for a, b in zip(self.levels, self.levels[1:], strict=False):
            for side in (self.left[a:b], self.right[a:b]):
                inner = side >= self.terminals
                below[a:b][inner] |= below[side[inner] - self.terminals]
        inner = self.roots >= self.terminals
        rules, at = self.roots[inner] - self.terminals, self.starts[inner]
        while len(rules):
            go = below[rules]
            rules, at = rules[go], at[go]
            own = wanted[rules]
            yield rules[own], at[own]
            sides = np.concatenate([self.left[rules], self.right[rules]])
            at = np.concatenate([at, at + self.half(rules)])
            inner = sides >= self.terminals
            rules, at = sides[inner] - self.terminals, at[inner]


def crossing_runs(tree: Derivation, codes: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Runs inside each rule that cross its boundary: rule, start from the rule's first word, length, period.

    All are compared word by word; should hashes have been wrong, they are found again without.
    """
    found = _crossing(tree, codes, least, Repeats(codes))
    if not agrees(codes, tree.place[found[0]] + found[1], *found[2:]):
        found = _crossing(tree, codes, least, Names(codes))
    return found


def _crossing(tree: Derivation, codes: np.ndarray, least: int, repeats: Repeats | Names) -> tuple[np.ndarray, ...]:
    """A run with period q over the boundary b agrees with itself at q words' distance either from b - q and b on, or up to b and b + q."""
    found = []
    rules = np.flatnonzero((tree.length >= least) & (tree.place >= 0))
    most = np.cumsum(tree.length[rules])
    blocks = np.searchsorted(most, np.arange(0, int(most[-1]) + COMPARED, COMPARED)) if len(rules) else []
    for x, y in zip(blocks, blocks[1:], strict=False):
        block = rules[x:y]
        if not len(block):
            continue
        start, size = tree.place[block], tree.length[block]
        cut, stop = start + tree.half(block), start + size
        for ahead in (False, True):
            periods = np.minimum(size // 2, (stop - cut) if ahead else (cut - start))
            q = ragged(np.ones(len(block), np.int64), periods)
            k = np.repeat(np.arange(len(block)), periods)
            b = cut[k] + q * ahead  # the later of the two places that are compared
            near = codes[b - 1] == codes[b - 1 - q] if ahead else codes[b] == codes[b - q]
            q, k, b = q[near], k[near], b[near]
            forth = repeats.agree(b - q, b, stop[k] - b, back=False)
            back = repeats.agree(b - q, b, b - q - start[k], back=True)
            whole = forth + back >= np.maximum(q, least - q)
            q, k, b, forth, back = (v[whole] for v in (q, k, b, forth, back))
            found.append((block[k], b - q - back - start[k], q + back + forth, q))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return smallest_periods(*(np.concatenate(v) for v in zip(*found, strict=True)))


def smallest_periods(owner: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of rows with the same owner, start and length, the one with the smallest period."""
    order = np.lexsort((period, length, start, owner))
    owner, start, length, period = owner[order], start[order], length[order], period[order]
    same = (owner[1:] == owner[:-1]) & (start[1:] == start[:-1]) & (length[1:] == length[:-1])
    keep = np.concatenate([[True], ~same])[: len(owner)]
    return owner[keep], start[keep], length[keep], period[keep]


def agrees(codes: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bool:
    """Whether the words of all runs are what their periods say, word by word."""
    for x in range(0, len(start), 1024):
        at = ragged(start[x : x + 1024], length[x : x + 1024] - period[x : x + 1024])
        gap = np.repeat(period[x : x + 1024], length[x : x + 1024] - period[x : x + 1024])
        if not (codes[at] == codes[at + gap]).all():
            return False
    return True


def find_runs(codes: np.ndarray, first: np.ndarray, least: int = LEAST_LENGTH) -> tuple[np.ndarray, ...]:
    """All runs of a slice: document, start in the slice, length and period, by document, start and period.

    ``first[d]:first[d + 1]`` are the words of document d.
    """
    least = max(2, least)
    counts = np.diff(first)
    docs = np.flatnonzero(counts)
    if not len(docs):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    names, ids = np.unique(codes, return_inverse=True)
    last = np.zeros(len(codes), bool)
    last[first[docs + 1] - 1] = True
    tree = Derivation(compress(ids, last, len(names)), first[docs])
    rule, start, length, period = crossing_runs(tree, codes, least)
    wanted = np.zeros(len(tree.length), bool)
    wanted[rule] = True
    begin, end = np.searchsorted(rule, np.arange(len(wanted))), np.searchsorted(rule, np.arange(len(wanted)), side="right")
    parts = []
    for rules, at in tree.places(wanted):
        times = end[rules] - begin[rules]
        k = ragged(begin[rules], times)
        s, n, q = np.repeat(at, times) + start[k], length[k], period[k]
        d = np.searchsorted(first, s, side="right") - 1
        e = s + n
        longer = (s > first[d]) & (codes[s - 1] == codes[s - 1 + q])
        longer |= (e < first[d + 1]) & (codes[np.minimum(e, len(codes) - 1)] == codes[np.minimum(e, len(codes) - 1) - q])
        parts.append(tuple(v[~longer] for v in (d, s, n, q)))
    d, s, n, q = smallest_periods(*(np.concatenate(v) for v in zip(*parts, strict=True))) if parts else (np.zeros(0, np.int64),) * 4
    order = np.lexsort((q, s, d))
    return d[order], s[order], n[order], q[order]


def describe(words: Words, texts: list[str | None], least: int) -> list[tuple]:
    d, s, n, q = find_runs(words.hash, words.first, least)
    begin, end = np.searchsorted(d, np.arange(len(texts))), np.searchsorted(d, np.arange(len(texts)), side="right")
    change = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(change, s + q, 1)
    np.add.at(change, s + n, -1)
    dropped = np.cumsum(change[:-1]) > 0
    rows = []
    for k, text in enumerate(texts):
        a, b, x, y = words.first[k], words.first[k + 1], begin[k], end[k]
        parts = (text or "").encode().split()
        if x == y:
            rows.append((b - a, 0, None, None, None, None, 0, [], b" ".join(parts).decode()))
            continue
        kept = b" ".join([parts[i] for i in np.flatnonzero(~dropped[a:b])])
        runs = np.column_stack([s[x:y] - a, n[x:y], q[x:y]])
        best = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]]
        listed = [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()]
        rows.append((b - a, y - x, *best.tolist(), 1000 * int(best[1]) // int(best[2]), int(dropped[a:b].sum()), listed, kept.decode()))
    return rows


def periodic_runs(df: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None, least: int = LEAST_LENGTH) -> DataFrame:
    """Each row of ``df`` with the runs of its text and the text with each run cut to its first period.

    A run is a longest stretch of words with smallest period q and at least
    max(``least``, 2 q) words. Columns: ``n_words``, ``n_runs``; ``start``, ``length``, ``period`` and ``exponent_milli`` of the longest
    run (of equal ones the first, then the smallest period; null without runs); ``runs`` by start and period; ``n_collapsed`` words that
    a run contains after its first period; ``collapsed``, the other words joined by one space. A null or empty
    text has no words. Repeated rows are answered alike, an empty table gives an empty one. ``keep`` lists the
    columns of ``df`` to return (all by default); those with the name of a result give way. Nothing is
    shuffled; a task holds one slice of texts, or the longest text.
    """
    results = set(FOUND.names)
    keep = tuple(c for c in (df.columns if keep is None else keep) if c not in results)
    source = df.select(*keep, df[text].cast("string").alias("__text"))
    listed = "array<struct<start:bigint,length:bigint,period:bigint>>"
    made = ", ".join(f"{f.name} {listed}" if f.name == "runs" else spark_schema(pa.schema([f])) for f in FOUND)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema), made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                rows = describe(Words(part.column("__text"), lower=False), part.column("__text").to_pylist(), least)
                made = record_batch(FOUND, **dict(zip(FOUND.names, map(list, zip(*rows, strict=True)), strict=True)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made.columns], names=[*keep, *FOUND.names])

    return source.mapInArrow(run, schema)


def with_periodic_tails(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` where about a tenth of the texts, chosen by the hash of their id, go on periodically from some word.

    With h = crc32 of the id as text and g = h / 10: if h % 10 = 0 and there are n > 0 words, word i from a = g % n on
    becomes word a + (i - a) % p, p = 1 + (n - a) / (3 + g % 8), whole divisions, and the words are joined by one space. A null id leaves its text as it is.
    """
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col(key).cast("string"))
    chosen = docs.where((h % 10 == 0) & F.col(text).isNotNull())
    others = docs.where(~F.coalesce((h % 10 == 0) & F.col(text).isNotNull(), F.lit(False)))
    g = F.floor(h / 10)
    sized = chosen.withColumn("__w", words).withColumn("__n", F.size("__w").cast("bigint"))
    placed = sized.withColumn("__a", F.when(F.col("__n") > 0, g % F.greatest(F.col("__n"), F.lit(1)))).withColumn("__p", 1 + F.floor((F.col("__n") - F.col("__a")) / (3 + g % 8)))
    turned = F.expr("transform(sequence(0L, greatest(__n, 1L) - 1), i -> element_at(__w, cast(if(i < __a, i, __a + (i - __a) % __p) + 1 as int)))")
    made = placed.withColumn(text, F.when(F.col("__n") > 0, F.array_join(turned, " ")).otherwise(F.col(text)))
    return made.select(*docs.columns).unionByName(others)
