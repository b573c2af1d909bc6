"""N-gram Jaccard join by parity sketches.

Each text is the set of its distinct word shingles. The parity sketch of a set
flips one bit per element; two sketches differ in at most as many bits as the
sets have elements apart, so their Hamming distance bounds the symmetric
difference from below. For a similarity of 80 % sets of sizes a and b may be
(a + b) / 9 elements apart. Within a size band the sketch is cut into more
blocks than that, so linked sets agree in at least one block (pigeonhole); the
blocks travel as 64-bit XOR codes and meet in packed shuffles. What meets is
screened by size and by the Hamming distance of dense sketches, then verified
on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenor.llm.components import components, joined_components
from provenor.llm.packing import deal, dealt, record_batch, shuffle_size, spark_schema
from provenor.llm.words import HASHED_BYTES, U, Words, mix, shingle_sets, slices
from provenor.operators.joins import keyed_join
from provenor.session import materialise

SHINGLE = 5
MAX_SKETCH_BITS = 1 << 16
CHUNK = 1024
RUN = 1 << 22
LABEL_SALTS = 32
BITS_PER_ID = 64
MAX_BITMAP_BITS = 1 << 27

SIGNED = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("check", pa.int64()), ("sketch", pa.binary()), ("coarse", pa.binary())])
PACKED = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("nodes", pa.binary())])
MEMBERS = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("rep", pa.int64())])
PAIRS = pa.schema([("x", pa.int64()), ("y", pa.int64())])
PACKED_PAIRS = pa.schema([("part", pa.int32()), ("x", pa.binary()), ("y", pa.binary()), ("key", pa.int64())])
SETS = pa.schema([("node", pa.int64()), ("id", pa.int64()), ("elements", pa.binary())])


def size_bands(largest: int) -> list[int]:
    """Lower bounds of the size bands up to one beyond ``largest``; smaller sets than the first only link with equal ones."""
    bounds = [4]
    while bounds[-1] <= largest:
        bounds.append(max(bounds[-1] + 1, bounds[-1] * 3 // 2))
    return [*bounds, bounds[-1] * 3 // 2, bounds[-1] * 9 // 4]


def n_blocks(top: int) -> int:
    """Blocks for sets of at most ``top`` elements: one more than may differ, and a few for blocks without elements."""
    d = 2 * top // 9
    return d + 2 + -(-3 * d // 100)


def block_codes(elements: np.ndarray, config: int, top: int) -> np.ndarray:
    """The codes of one set's blocks. ``elements`` are sorted, so blocks (their high bits) are ranges.

    A block without elements says little and is left out, unless so many are
    empty that linked sets might agree in no other block.
    """
    k, n = n_blocks(top), len(elements)
    block = ((elements >> U(32)) * U(k)) >> U(32)
    at = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1])
    codes = mix(np.bitwise_xor.reduceat(mix(elements), at) ^ mix((block[at] + U(config << 32)) * U(0x9E3779B97F4A7C15)))
    apart = min(n // 4, (n + top) // 9)
    if k - apart - (k - len(at)) < 1:
        empty = np.setdiff1d(np.arange(k, dtype=U), block[at])
        codes = np.concatenate([codes, mix(mix(empty + U(config << 32)) + U(1))])
    return codes


def set_codes(elements: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    n = len(elements)
    if n < bounds[0]:
        return np.zeros(0, U)
    band = int(np.searchsorted(bounds, n, side="right")) - 1
    codes = [block_codes(elements, band, int(bounds[band + 1]) - 1)]
    if 5 * n >= 4 * bounds[band + 1]:  # a linked set may be in the next band
        codes.append(block_codes(elements, band + 1, int(bounds[band + 2]) - 1))
    return np.concatenate(codes)


def parity_sketch(elements: np.ndarray) -> bytes:
    """Two bits per element or more, a power of two of them, so that a longer sketch folds onto a shorter one."""
    bits = min(MAX_SKETCH_BITS, max(64, 1 << (2 * max(len(elements), 1) - 1).bit_length()))
    odd = np.bincount((elements & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def fold(sketch: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(sketch.reshape(-1, size), axis=0)


def node_of(elements: np.ndarray) -> tuple[int, int]:
    """Two 64-bit values of a set: its identity and a check."""
    a = mix(elements + U(3)).sum(dtype=U) ^ U(len(elements))
    b = np.bitwise_xor.reduce(mix(elements ^ U(0x5851F42D4C957F2D))) if len(elements) else U(0)
    return int(mix(np.array([a]))[0].astype(np.int64)), int(b.astype(np.int64))


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part in slices(batch, "text"):
            yield part, [s for few in slices(part, "text", HASHED_BYTES) for s in shingle_sets(Words(few.column("text"), lower=True), n)]


def signatures(docs: DataFrame, n: int) -> DataFrame:
    def run(batches):
        for part, sets in _sets(batches, n):
            nodes, sketches = [node_of(s) for s in sets], [parity_sketch(s) for s in sets]
            yield record_batch(
                SIGNED, id=part.column("id"), n=[len(s) for s in sets], node=[a for a, _ in nodes], check=[b for _, b in nodes], sketch=sketches,
                coarse=[fold(np.frombuffer(s, np.uint8), len(s) // 2).tobytes() for s in sketches],
            )

    return docs.mapInArrow(run, spark_schema(SIGNED))


def packed_codes(docs: DataFrame, n: int, bounds: list[int], parts: int) -> DataFrame:
    """Block codes of all texts, one row per slice of texts and part; equal sets of a slice count once."""
    bounds = np.array(bounds)

    def run(batches):
        for _, sets in _sets(batches, n):
            by_node = {node_of(s)[0]: s for s in sets if len(s)}
            codes = [set_codes(s, bounds) for s in by_node.values()]
            if not codes:
                continue
            nodes = np.fromiter(by_node, np.int64, len(by_node))
            owner = np.repeat(np.arange(len(nodes)), [len(c) for c in codes])
            flat = np.concatenate(codes)
            rows = []
            for part, at in dealt(((flat >> U(32)) * U(parts) >> U(32)).astype(np.int32), parts):
                own = owner[at]
                first = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
                counts = np.diff(np.concatenate([first, [len(own)]])).astype(np.uint32)
                rows.append((part, flat[at].astype(np.uint32).tobytes(), counts.tobytes(), nodes[own[first]].tobytes()))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield record_batch(PACKED, **dict(zip(PACKED.names, map(list, columns), strict=True)))

    return docs.mapInArrow(run, spark_schema(PACKED))


class _Met:
    """Codes of one part seen so far, each with its first set. Runs of entries are sorted and matched; memory follows the distinct codes."""

    def __init__(self, part: int):
        self.part, self.waiting, self.size = part, [], 0
        self.keys, self.reps, self.told = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, keys: np.ndarray, nodes: np.ndarray) -> bool:
        self.waiting.append((keys, nodes))
        self.size += len(keys)
        return self.size >= RUN

    def match(self) -> pa.RecordBatch | None:
        if not self.waiting:
            return None
        keys, nodes = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting, self.size = [], 0
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])])
        keys, nodes = keys[new], nodes[new]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.concatenate([first, [len(keys)]]))
        own, lowest = keys[first], nodes[first]
        at = np.searchsorted(self.keys, own)
        known = np.zeros(len(own), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == own
        rep = np.where(known, self.reps[np.minimum(at, max(len(self.keys) - 1, 0))] if len(self.keys) else lowest, lowest)
        others = np.add.reduceat((nodes != np.repeat(rep, sizes)).astype(np.int64), first)
        meets = others > 0
        tell = np.repeat(meets, sizes)
        out = [(np.repeat(own, sizes)[tell], nodes[tell], np.repeat(rep, sizes)[tell])]
        late = meets & known
        late[late] = ~self.told[at[late]]
        self.told[at[late]] = True
        out.append((own[late], rep[late], rep[late]))  # a first set whose code had been met by no other one
        fresh = ~known
        keys_all = np.concatenate([self.keys, own[fresh]])
        order = np.argsort(keys_all, kind="stable")
        self.keys, self.reps = keys_all[order], np.concatenate([self.reps, lowest[fresh]])[order]
        self.told = np.concatenate([self.told, meets[fresh]])[order]
        k, m, r = (np.concatenate(x) for x in zip(*out, strict=True))
        return record_batch(MEMBERS, key=(k.astype(np.int64) + (self.part << 32)), node=m, rep=r) if len(k) else None


def members(packed: DataFrame, parts: int) -> DataFrame:
    """``key``, ``node``, ``rep`` for every block code that two sets or more have; ``rep`` is one of them, the same for the code."""
    def run(batches):
        parts_met: dict[int, _Met] = {}
        for batch in batches:
            for row in batch.to_pylist():
                met = parts_met.setdefault(row["part"], _Met(row["part"]))
                counts = np.frombuffer(row["counts"], np.uint32)
                if met.add(np.frombuffer(row["keys"], np.uint32), np.repeat(np.frombuffer(row["nodes"], np.int64), counts)) and (out := met.match()) is not None:
                    yield out
        for met in parts_met.values():
            if (out := met.match()) is not None:
                yield out

    return deal(packed, parts).mapInArrow(run, spark_schema(MEMBERS))


def may_link(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Sizes that allow a similarity of 80 %."""
    return (4 * na <= 5 * nb) & (4 * nb <= 5 * na)


def screened(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (x, y) whose sizes and sketches allow a link."""
    a = nodes.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("sketch").alias("sx"))
    b = nodes.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("sketch").alias("sy"))
    joined = pairs.join(a, "x").join(b, "y").where("4 * nx <= 5 * ny and 4 * ny <= 5 * nx")

    def run(batches):
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("nx", "ny"))
            left, right = batch.column("sx").to_pylist(), batch.column("sy").to_pylist()
            keep = [hamming(np.frombuffer(s, np.uint8), np.frombuffer(t, np.uint8)) <= (p + q) // 9 for s, t, p, q in zip(left, right, na, nb, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["x", "y"])

    return joined.select("x", "y", "nx", "ny", "sx", "sy").mapInArrow(run, spark_schema(PAIRS))


def hamming(a: np.ndarray, b: np.ndarray) -> int:
    size = min(len(a), len(b))
    return int(np.bitwise_count(fold(a, size) ^ fold(b, size)).sum())


def wanted_sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """``node`` and ``elements`` (its full set) for rows ``node``, ``id`` of ``ids``, a stored table.

    A bitmap of the hashed ids, of 16 MB at most, goes to the tasks, which leave
    out most other texts before anything is shuffled; the join drops the few
    that a shared bit lets through.
    """
    spark = docs.sparkSession
    bits = min(MAX_BITMAP_BITS, max(1 << 15, 1 << (BITS_PER_ID * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64("id"), F.lit(bits))
    blocks = ids.where("id is not null").select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    bitmap = np.zeros((bits >> 15) + 2, f"V{1 << 12}")
    for row in blocks.toLocalIterator():
        bitmap[row["block"]] = bytes(row["bits"])
    # blocks are numbered from 1, and number b has the places up to b * 2^15
    numbers = docs.where("id is not null").select("id", "text", F.bitmap_bucket_number(place).alias("block"), F.bitmap_bit_position(place).alias("bit"))
    sent = spark.sparkContext.broadcast(bitmap.view(np.uint8))

    def run(batches):
        held = sent.value
        for batch in batches:
            block, bit = (batch.column(c).to_numpy() for c in ("block", "bit"))
            told = held[(block << 12) + (bit >> 3)] >> (bit & 7).astype(np.uint8) & 1
            for part, sets in _sets([batch.filter(pa.array(told.astype(bool)))], n):
                yield record_batch(SETS, node=[node_of(s)[0] for s in sets], id=part.column("id"), elements=[s.tobytes() for s in sets])

    found = numbers.mapInArrow(run, spark_schema(SETS)).where("octet_length(elements) > 0")
    return found.join(ids.select("node", "id"), ["node", "id"], "left_semi").dropDuplicates(["node"]).select("node", "elements")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """The pairs whose full shingle sets have 100 * intersection >= 80 * union."""
    wanted = pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node"))).distinct()
    ids = materialise(nodes.join(wanted, "node", "left_semi").select("node", "id"), "wanted")
    sets = materialise(wanted_sets(docs, ids, n), "sets")
    a = sets.select(F.col("node").alias("x"), F.col("elements").alias("ex"))
    b = sets.select(F.col("node").alias("y"), F.col("elements").alias("ey"))

    def run(batches):
        for batch in batches:
            keep = []
            for p, q in zip(batch.column("ex"), batch.column("ey"), strict=True):
                s, t = np.frombuffer(p.as_buffer(), U), np.frombuffer(q.as_buffer(), U)
                both = len(s) + len(t) - len(np.union1d(s, t))
                keep.append(100 * both >= 80 * (len(s) + len(t) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["x", "y"])

    return pairs.join(a, "x").join(b, "y").select("x", "y", "ex", "ey").mapInArrow(run, spark_schema(PAIRS))


def sorted_groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by ``column``."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(column).to_numpy()
        last = int(np.searchsorted(keys, keys[-1], side="left"))
        if last:
            yield pa.Table.from_batches([*waiting, batch.slice(0, last)])
            waiting = []
        elif waiting and waiting[-1].column(column)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(waiting)
            waiting = []
        waiting.append(batch.slice(last))
    if waiting:
        yield pa.Table.from_batches(waiting)


def cross_pairs(rest: DataFrame, nodes: DataFrame, closest: bool) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs of sets of different components that share a code and pass a coarse screen, from rows key, node, label and the ``nodes``.

    With ``closest`` only the nearest pair of each two components that meet in a
    code; the second frame has the codes (``key``) of which pairs were so left out.
    A code with many sets is dealt as pairs of chunks of ``CHUNK`` sets each,
    so a task holds two chunks at a time. Sets that share many codes are found
    many times: pairs travel packed and the repeated ones end at their destination.
    Sketches join the rows last and are shuffled once.
    """
    parts = shuffle_size(rest.sparkSession)
    sizes = rest.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    spread = rest.join(sizes, "key").withColumn("own", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    spread = spread.withColumn("meeting", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    spread = spread.select("meeting", "key", "own", "other", "node", "label").join(nodes.select("node", "n", "coarse"), "node")
    spread = spread.repartition(parts, "meeting").sortWithinPartitions("meeting", "own", "node")

    def run(batches):
        for table in sorted_groups(batches, "meeting"):
            meeting, key, own, other, node, label, size = (table.column(c).to_numpy() for c in ("meeting", "key", "own", "other", "node", "label", "n"))
            sketches = [np.frombuffer(s, np.uint8) for s in table.column("coarse").to_pylist()]
            first = np.flatnonzero(np.concatenate([[True], meeting[1:] != meeting[:-1]]))
            found, left = [], []
            for a, b in zip(first, [*first[1:], len(meeting)], strict=True):
                width = min(len(s) for s in sketches[a:b])
                bits = np.stack([fold(s, width) for s in sketches[a:b]])
                m, l, s, o = node[a:b], label[a:b], size[a:b], own[a:b]
                within = bool((own[a:b] == other[a:b]).all())
                passed = []
                for i in range(b - a - 1):
                    j = np.arange(i + 1, b - a)
                    j = j[(l[j] != l[i]) & may_link(s[j], s[i]) & (within | (o[j] != o[i]))]
                    if len(j):
                        apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1).astype(np.int64)
                        near = apart <= (s[j] + s[i]) // 9
                        passed.append(np.stack([np.full(near.sum(), i), j[near], apart[near]]))
                if passed:
                    i, j, apart = np.concatenate(passed, axis=1)
                    if closest:
                        low, high = np.minimum(l[i], l[j]), np.maximum(l[i], l[j])
                        order = np.lexsort((j, i, apart, high, low))
                        low, high, i, j = low[order], high[order], i[order], j[order]
                        lead = np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])[: len(i)]
                        i, j = i[lead], j[lead]
                        if not lead.all():
                            left.append(int(key[a]))
                    found.append(np.stack([np.minimum(m[i], m[j]), np.maximum(m[i], m[j])]))
            if found:
                x, y = np.unique(np.concatenate(found, axis=1), axis=1)
                to = ((mix(x.view(U) ^ mix(y.view(U))) >> U(32)) * U(parts) >> U(32)).astype(np.int32)
                rows = [(p, x[at].tobytes(), y[at].tobytes(), None) for p, at in dealt(to, parts)] + [(None, None, None, k) for k in left]
                yield record_batch(PACKED_PAIRS, **dict(zip(PACKED_PAIRS.names, map(list, zip(*rows, strict=True)) if rows else [[]] * 4, strict=True)))

    def unite(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                own = held.setdefault(row["part"], [])
                own.append(np.stack([np.frombuffer(row["x"], np.int64), np.frombuffer(row["y"], np.int64)]))
                if len(own) > 256:
                    held[row["part"]] = [np.unique(np.concatenate(own, axis=1), axis=1)]
        for own in held.values():
            x, y = np.unique(np.concatenate(own, axis=1), axis=1)
            yield record_batch(PAIRS, x=x, y=y)

    packed = materialise(spread.mapInArrow(run, spark_schema(PACKED_PAIRS)), "packed")
    pairs = deal(packed.where("key is null").select("part", "x", "y"), parts).mapInArrow(unite, spark_schema(PAIRS))
    return pairs, packed.where("key is not null").select("key").distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` for each row of ``df``.

    Two rows link when their sets of ``n``-word shingles (A-Z lower-cased; a
    shorter text is one shingle) have a similarity of 80 % or more;
    ``component_id`` is the smallest id reachable by links. Rows that repeat, and
    equal sets, are one node with several ids. A null, empty or blank text has no
    shingles, links with nothing and is its own component, as is a null id alone.
    Ids are integers; other columns are not read. An empty table gives an empty one.

    Links are followed in three turns, and none is lost: every set is compared
    with one representative per shared block code; then the nearest sets of any
    two components that still share a code; then all sets that share a code and
    lie in different components, in chunks. A large group of copies thus costs
    few comparisons per copy. Equal sets are found by 128 bits of hash, block
    codes and shingles by 64.
    """
    spark = df.sparkSession
    docs = df.select(df[key].cast("bigint").alias("id"), df[text].alias("text"))
    signed = materialise(signatures(docs, n), "signatures")
    nodes = signed.where("n > 0").groupBy("node", "check").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("coarse").alias("coarse"))
    nodes = materialise(nodes, "nodes")
    largest = nodes.agg(F.max("n")).first()[0] or 0
    parts = shuffle_size(spark)
    met = materialise(members(packed_codes(docs, n, size_bands(largest), parts), parts), "members")

    member = materialise(met.select("key", "node").distinct(), "codes")
    tested = materialise(met.where("node <> rep").select(F.least("node", "rep").alias("x"), F.greatest("node", "rep").alias("y")).distinct(), "tested")
    links = materialise(verified(materialise(screened(tested, nodes), "pairs"), nodes, docs, n), "links")
    joined = materialise(components(links, "x", "y"), "components")
    for closest in (True, False):
        placed = member.join(joined, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"))
        open_keys = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
        found, left = cross_pairs(placed.join(open_keys, "key", "left_semi"), nodes, closest)
        member = member.join(left, "key", "left_semi")
        met_again = materialise(found, "cross")
        new = met_again.join(tested, ["x", "y"], "left_anti")
        tested = tested.unionByName(met_again)
        joined = joined_components(joined, verified(materialise(screened(new, nodes), "pairs"), nodes, docs, n), "x", "y")

    labelled = signed.join(joined, "node", "left").withColumn("label", F.when(F.col("n") > 0, F.coalesce("component", "node")))
    lowest = labelled.where("n > 0").groupBy("label").agg(F.min("id").alias("lowest"))
    return keyed_join(labelled, lowest, ["label"], "left", salts=LABEL_SALTS).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("lowest")).otherwise(F.col("id")).alias("component_id")
    )
