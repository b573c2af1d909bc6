"""Language-model scores by deleted interpolation.

The probability of a token after another mixes maximum-likelihood estimates of
the bigram, the unigram and a uniform distribution. The weights depend on how
often the context occurs (one set per power of two) and are learned by
expectation-maximisation on held-out documents. Every token has its own counts,
however many types there are; tokens never heard form one class that stands for
one unseen type, so probabilities add up to one. Only where ``vocabulary`` is
given, all but that many most frequent tokens join this class, whose probability
its types share equally.

The distinct tokens and bigrams of a slice of texts travel packed, dealt by their
hashes; their counts over all slices come back in the same order and meet the
slice's tokens again, where its texts are scored. No table of tokens reaches the
driver or every task, and what is moved follows the tokens, not the number of
partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenor.llm.packing import deal, dealt, record_batch, shuffle_size, spark_schema
from provenor.llm.words import U, Words, mix, run_hash, slices
from provenor.operators.ordering import stored_input
from provenor.session import materialise

BUCKETS = 32
BINS = 256
END = U(0x2545F4914F6CDD1D)
RARE = U(0x9FB21C651E98DF25)

PACKED = pa.schema([("part", pa.int32()), ("slice", pa.int64()), ("keys", pa.binary()), ("trained", pa.binary())])
TOLD = pa.schema([("word", pa.int64())])
CELLS = pa.schema([("cell", pa.int64()), ("n", pa.int64())])
MEETING = pa.schema([
    ("slice", pa.int64()), ("part", pa.int32()), ("counts", pa.binary()), ("ids", pa.binary()), ("null", pa.binary()), ("held", pa.binary()), ("first", pa.binary()),
    ("words", pa.binary()), ("back", pa.binary()),
])
HEARD = pa.schema([
    ("bins", pa.binary()), ("ids", pa.binary()), ("null", pa.binary()), ("held", pa.binary()), ("first", pa.binary()), ("start", pa.int64()), ("back", pa.binary()),
    ("heard", pa.binary()), ("pairs", pa.binary()),
])
SCORES = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()),
    ("score", pa.float64()),
])


def pack(values: np.ndarray) -> bytes:
    """Byte planes, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), 1)


def unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).ravel()


class Tokens:
    """The tokens of a slice: lower-cased words, and one end per text."""

    def __init__(self, texts: pa.Array):
        words = Words(texts, lower=True)
        self.hash = np.insert(words.hash, words.first[1:], END)
        self.first = words.first + np.arange(len(words.first))
        self.owner = np.repeat(np.arange(len(words.first) - 1), np.diff(self.first))


def summed(rows: list) -> tuple[np.ndarray, np.ndarray]:
    words, back = np.unique(np.concatenate([w for w, _ in rows]), return_inverse=True)
    return words, np.bincount(back, np.concatenate([c for _, c in rows])).astype(np.int64)


def count_bin(counts: np.ndarray) -> np.ndarray:
    """64 bins per power of two; -1 for what never occurs."""
    return np.where(counts > 0, np.floor(np.log2(np.maximum(counts, 1)) * 64), -1).astype(np.int64)


class Model:
    """The count bins of the tokens told apart, how many tokens are in each, totals and weights.

    All other tokens are of the rare class; without ``told``, every type is told apart.
    """

    def __init__(self, bins: np.ndarray, counts: np.ndarray, tokens: int, types: int, told: int | None = None):
        self.low, self.tokens, self.types = int(min(bins, default=1 << 30)), tokens, types
        self.rare_types = 0 if told is None else types - told
        self.rare_count = tokens - int(np.sum(counts))
        self.weights = np.tile([0.6, 0.3, 0.1], (BUCKETS, 1))

    def classes(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which tokens that occur so often are of the rare class, and how often each token or its class occurs."""
        rare = (counts == 0) | (count_bin(counts) < self.low)
        return rare, np.where(rare, self.rare_count, counts)

    def bucket(self, c1: np.ndarray) -> np.ndarray:
        return np.log2(np.maximum(c1, 1)).astype(np.int64).clip(0, BUCKETS - 1)

    def estimates(self, c1: np.ndarray, c2: np.ndarray, rare: np.ndarray, c12: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Of bigrams whose tokens occur ``c1`` and ``c2`` times, the second in the rare class or not."""
        share = np.where(rare, 1.0 / (self.rare_types + 1), 1.0)
        return share * c12 / np.maximum(c1, 1), share * c2 / max(self.tokens, 1), 1.0 / (self.types + 1)

    def learn(self, cells: np.ndarray, times: np.ndarray, rounds: int = 60) -> None:
        """Expectation-maximisation on the binned estimates of all bigrams, each without the counts of its own text."""
        if not len(cells):
            return
        bucket, p2, p1 = cells // BINS**2, value(cells // BINS % BINS), value(cells % BINS)
        p = np.stack([p2, p1, np.full(len(cells), 1.0 / (self.types + 1))], axis=1)

        def fitted(p, times, start):
            w = start
            for _ in range(rounds):
                part = p * w
                part *= (times / part.sum(axis=1))[:, None]
                w = np.maximum(part.sum(axis=0), 1e-6 * times.sum())
                w = w / w.sum()
            return w

        whole = fitted(p, times, self.weights[0])
        self.weights = np.tile(whole, (BUCKETS, 1))
        for b in np.unique(bucket):
            own = bucket == b
            self.weights[b] = fitted(p[own], times[own], whole)


def binned(p: np.ndarray) -> np.ndarray:
    """Eighths of a power of two below one; the last bin is zero."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(np.round(-8 * np.log2(np.maximum(p, 1e-300))), BINS - 2), BINS - 1).astype(np.int64)


def value(bins: np.ndarray) -> np.ndarray:
    return np.where(bins == BINS - 1, 0.0, 2.0 ** (-bins / 8))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((mix(keys) >> U(32)) * U(parts) >> U(32)).astype(np.int32)


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as steps."""
    steps = keys.copy()
    steps[1:] -= keys[:-1]
    return pack(steps)


def batch_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return record_batch(schema, **dict(zip(schema.names, map(list, zip(*rows, strict=True)) if rows else [[]] * len(schema.names), strict=True)))


def slices_of(batches):
    """Each slice with its tokens, the distinct ones, and an id of the slice that follows from its texts."""
    for batch in batches:
        for part in slices(batch, "text"):
            tokens = Tokens(part.column("text"))
            marks = part.column("mark").to_numpy().astype(np.int64)
            name = int(run_hash(mix(marks.view(U)), len(marks)).view(np.int64)[0])
            words, back = np.unique(tokens.hash, return_inverse=True)
            yield part, tokens, words, back, name


def bigrams(back: np.ndarray, first: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second token of the distinct bigrams of a slice, by their numbers in it, and the bigram of each token."""
    before = np.concatenate([[start], back[:-1]]).astype(U)
    before[first[:-1]] = start
    keys, at = np.unique(before << U(32) | back.astype(U), return_inverse=True)
    return (keys >> U(32)).astype(np.int64), (keys & U(0xFFFFFFFF)).astype(np.int64), at


def pair_keys(words: np.ndarray, one: np.ndarray, two: np.ndarray, told: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the bigrams, and the one of each; tokens outside ``told`` count as one."""
    names = words if told is None else np.where(np.isin(words, told), words, RARE)
    return np.unique(mix(names[one] + mix(names[two] ^ END)), return_inverse=True)


def packed(docs: DataFrame, parts: int, told=None, pairs: bool = True) -> DataFrame:
    """The distinct tokens and bigrams of each slice and how often texts that teach have them; bigrams in parts ``parts`` and up. One partition has a part of each."""
    def run(batches):
        for part, tokens, words, back, name in slices_of(batches):
            taught = ~part.column("held").to_numpy(zero_copy_only=False)[tokens.owner]
            found = [(words, back, 0)]
            if pairs:
                one, two, at = bigrams(back, tokens.first, int(np.searchsorted(words, END)))
                keys, again = pair_keys(words, one, two, told and told.value)
                found.append((keys, again[at], parts))
            rows = []
            for keys, at, base in found:
                trained = np.bincount(at[taught], minlength=len(keys)).astype(np.uint32)
                rows += [(base + p, name, packed_keys(keys[own]), pack(trained[own])) for p, own in dealt(part_of(keys, parts), parts)]
            yield batch_of(PACKED, rows)

    rows = docs.mapInArrow(run, spark_schema(PACKED))
    return deal(rows.withColumn("lot", F.pmod("part", F.lit(parts))), parts, "lot").drop("lot")


def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict], np.ndarray, np.ndarray]]:
    """Each part, its rows, its keys and their training counts over all slices."""
    parts: dict[int, list[dict]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            parts.setdefault(row["part"], []).append(row)
    for part, rows in parts.items():
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for row in rows:
            found.append((np.cumsum(unpack(row["keys"], U), dtype=U), unpack(row["trained"], np.uint32)))
            if len(found) > 16:
                found = [summed(found)]
        yield part, rows, *summed(found)


def histogram(counts: np.ndarray) -> np.ndarray:
    """Count bins, their types and their tokens."""
    counts = counts[counts > 0]
    bins, back = np.unique(count_bin(counts), return_inverse=True)
    return np.stack([bins, np.bincount(back, minlength=len(bins)), np.bincount(back, counts, len(bins)).astype(np.int64)])


def by_key(keys: np.ndarray, got: dict[int, bytes], parts: int, base: int) -> np.ndarray:
    """The counts that came back, in the order of the keys."""
    out = np.zeros(len(keys), np.int64)
    for p, at in dealt(part_of(keys, parts), parts):
        out[at] = unpack(got[base + p], np.int64)
    return out


def heard_slices(docs: DataFrame, parts: int, told) -> DataFrame:
    """Each slice: its rows, their tokens, and the training counts of its distinct tokens and bigrams; and rows with count bins only."""
    def answers(batches):
        for part, rows, keys, counts in totals(batches):
            if part < parts:
                yield batch_of(MEETING, [(None, -2, histogram(counts).astype(np.int64).tobytes(), *[None] * 6)])
            for row in rows:
                own = counts[np.searchsorted(keys, np.cumsum(unpack(row["keys"], U), dtype=U))]
                yield batch_of(MEETING, [(row["slice"], part, pack(own.astype(np.int64)), *[None] * 6)])

    def questions(batches):
        for part, tokens, words, back, name in slices_of(batches):
            ids = part.column("id")
            yield batch_of(MEETING, [(
                name, -1, None, ids.fill_null(0).to_numpy().astype(np.int64).tobytes(), ids.is_null().to_numpy(zero_copy_only=False).tobytes(),
                part.column("held").to_numpy(zero_copy_only=False).tobytes(), tokens.first.astype(np.int64).tobytes(), packed_keys(words), pack(back.astype(np.uint32)),
            )])

    def heard(row, got):
        words, back, first = np.cumsum(unpack(row["words"], U), dtype=U), unpack(row["back"], np.uint32), np.frombuffer(row["first"], np.int64)
        start = int(np.searchsorted(words, END))
        one, two, _ = bigrams(back, first, start)
        keys, again = pair_keys(words, one, two, told and told.value)
        counts, together = by_key(words, got, parts, 0), by_key(keys, got, parts, parts)[again]
        return batch_of(HEARD, [(None, row["ids"], row["null"], row["held"], row["first"], start, row["back"], pack(counts), pack(together))])

    def meet(batches):
        asked: list[dict] = []
        got: dict[int, bytes] = {}
        current = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] == -2:
                    yield batch_of(HEARD, [(row["counts"], *[None] * 8)])
                    continue
                if row["slice"] != current:
                    yield from (heard(x, got) for x in asked)  # more than one only where slices are equal
                    asked, got, current = [], {}, row["slice"]
                if row["part"] == -1:
                    asked.append(row)
                else:
                    got[row["part"]] = row["counts"]
        yield from (heard(x, got) for x in asked)

    both = packed(docs, parts, told).mapInArrow(answers, spark_schema(MEETING)).unionByName(docs.mapInArrow(questions, spark_schema(MEETING)))
    return both.repartition(parts, "slice").sortWithinPartitions("slice", "part").mapInArrow(meet, spark_schema(HEARD))


def told_apart(docs: DataFrame, parts: int, vocabulary: int) -> np.ndarray:
    """The hashes of the most frequent tokens: as many whole count bins as have at most ``vocabulary`` types."""
    words = materialise(packed(docs, parts, pairs=False), "words")

    def bins(batches):
        for _, _, _, counts in totals(batches):
            yield pa.RecordBatch.from_arrays([pa.array([histogram(counts).astype(np.int64).tobytes()], pa.binary())], names=["bins"])

    low = model_of([r["bins"] for r in words.mapInArrow(bins, "bins binary").toLocalIterator()], vocabulary).low

    def told(batches):
        for _, _, keys, counts in totals(batches):
            yield record_batch(TOLD, word=keys[(counts > 0) & (count_bin(counts) >= low)].view(np.int64))

    return np.sort(words.mapInArrow(told, spark_schema(TOLD)).toArrow().column("word").to_numpy().view(U))


def model_of(parts: list[bytes], vocabulary: int | None) -> Model:
    """From the histograms of all parts: all tokens told apart, or those of ``told_apart``."""
    bins: dict[int, np.ndarray] = {}
    for data in parts:
        for b, *n in np.frombuffer(data, np.int64).reshape(3, -1).T.tolist():
            bins[b] = bins.get(b, np.zeros(2, np.int64)) + n
    kept, told = [], 0
    for b in sorted(bins, reverse=True):
        if vocabulary is not None and told + bins[b][0] > vocabulary:
            break
        kept.append(b)
        told += int(bins[b][0])
    types, tokens = (int(sum(n[i] for n in bins.values())) for i in (0, 1))
    return Model(np.array(kept), np.array([bins[b][1] for b in kept], np.int64), tokens, types, told)


class Estimates:
    """A slice read back: its rows, its distinct bigrams and what their estimates need."""

    def __init__(self, row: dict, m: Model):
        back, self.heard = unpack(row["back"], np.uint32), unpack(row["heard"], np.int64)
        self.first, self.held = np.frombuffer(row["first"], np.int64), np.frombuffer(row["held"], bool)
        self.owner = np.repeat(np.arange(len(self.held)), np.diff(self.first))
        self.one, self.two, self.back = bigrams(back, self.first, row["start"])
        self.word, self.heard_tokens, self.pairs = back.astype(np.int64), self.heard[back], unpack(row["pairs"], np.int64)
        self.rare, self.counts = m.classes(self.heard)

    def estimates(self, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """The context bucket of each distinct bigram and its three estimates."""
        c1 = self.counts[self.one]
        return m.bucket(c1), *m.estimates(c1, self.counts[self.two], self.rare[self.two], self.pairs)

    def deleted(self, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Buckets and estimates of the bigrams of each text that teaches, without its own counts, and how often it has them."""
        size = len(self.heard) + 1
        name = np.where(self.rare, size - 1, np.arange(size - 1))  # rare tokens have the counts of their class
        at = np.flatnonzero(~self.held[self.owner])
        owner, a, b = self.owner[at], name[self.one[self.back[at]]], name[self.two[self.back[at]]]
        _, first, times = np.unique((owner * size + a) * size + b, return_index=True, return_counts=True)
        own, n_own = np.unique(owner * size + name[self.word[at]], return_counts=True)
        owner, a, b, pair = owner[first], a[first], b[first], self.back[at[first]]
        mine = [n_own[np.searchsorted(own, owner * size + x)] for x in (a, b)]
        c1, c2 = self.counts[self.one[pair]] - mine[0], self.counts[self.two[pair]] - mine[1]
        p2, p1, _ = m.estimates(c1, c2, self.rare[self.two[pair]], self.pairs[pair] - times)
        left = np.maximum(m.tokens - np.diff(self.first)[owner], 1)
        return m.bucket(c1), p2, p1 * m.tokens / left, times


def deleted_cells(heard: DataFrame, model) -> DataFrame:
    """How many bigrams of texts that teach have each binned pair of estimates without the text's own counts, per bucket of the context."""
    def run(batches):
        found = []
        for batch in batches:
            for row in batch.to_pylist():
                bucket, p2, p1, times = Estimates(row, model.value).deleted(model.value)
                cells, back = np.unique((bucket * BINS + binned(p2)) * BINS + binned(p1), return_inverse=True)
                found.append((cells, np.bincount(back, times, len(cells)).astype(np.int64)))
                if len(found) > 64:
                    found = [summed(found)]
        if found:
            cells, times = summed(found)
            yield record_batch(CELLS, cell=cells, n=times)

    return heard.mapInArrow(run, spark_schema(CELLS)).groupBy("cell").agg(F.sum("n").alias("n"))


def scores(heard: DataFrame, model) -> DataFrame:
    """The result, one row per text."""
    def run(batches):
        m: Model = model.value
        for batch in batches:
            for row in batch.to_pylist():
                own = Estimates(row, m)
                bucket, p2, p1, p0 = own.estimates(m)
                w = m.weights[bucket]
                logs = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] * p0)[own.back]
                base = np.log10((own.heard_tokens + 1) / float(m.tokens + m.types + 1))
                at, n = own.first[:-1], len(own.held)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.frombuffer(row["ids"], np.int64), mask=np.frombuffer(row["null"], bool)), pa.array(own.held), pa.array(np.diff(own.first)),
                    pa.array(np.bincount(own.owner[own.heard_tokens > 0], minlength=n).astype(np.int64)), pa.array(np.full(n, m.tokens, np.int64)),
                    pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(logs, at)),
                ], schema=SCORES)

    return heard.mapInArrow(run, spark_schema(SCORES))


def score(df: DataFrame, held_out, key: str = "doc_id", text: str = "text", vocabulary: int | None = None, stored: bool = False) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` for each row of ``df``.

    ``held_out`` is a boolean column: rows that teach nothing; a null
    counts as false. A null or empty text is one end token. Rows that repeat are
    scored alike and each teaches; other columns are not read. Without training
    rows nothing is known, every estimate is uniform and the weights stay as they start. An empty table gives an empty one.
    ``base_score`` uses add-one unigrams over all tokens; ``score`` the
    interpolated bigrams, the end token standing before the first word. All
    tokens are told apart unless ``vocabulary`` bounds their number. Texts are read
    twice and must come in the same order both times, as they do from a stored table
    (``stored``); other rows are stored first.
    """
    spark = df.sparkSession
    parts = shuffle_size(spark)
    docs = df.select(
        df[key].cast("bigint").alias("id"), F.xxhash64(df[key].isNull(), df[key].cast("bigint"), df[text].isNull(), df[text]).alias("mark"),
        F.coalesce(held_out, F.lit(False)).alias("held"), df[text].alias("text"),
    )
    docs = stored_input(docs, stored)
    told = None if vocabulary is None else spark.sparkContext.broadcast(told_apart(docs, parts, vocabulary))
    heard = materialise(heard_slices(docs, parts, told), "slices")
    m = model_of([r["bins"] for r in heard.where("bins is not null").select("bins").toLocalIterator()], vocabulary)
    rows = heard.where("bins is null")
    cells = deleted_cells(rows, spark.sparkContext.broadcast(m)).toArrow()
    m.learn(cells.column("cell").to_numpy(), cells.column("n").to_numpy().astype(float))
    return scores(rows, spark.sparkContext.broadcast(m))
