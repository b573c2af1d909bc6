"""N-gram Jaccard join, its sketches, and substring dedup against brute force."""

import os
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from provenor.llm import jaccard, repeats
from provenor.llm.components import components
from provenor.llm.words import Words, shingle_sets
from provenor.session import SHUFFLE_CLEANUP, materialise

from . import brute

SCHEMA = "doc_id bigint, text string"


def corpus(seed, n=160):
    """Copies, near copies at every distance, shared passages, short, empty and null texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    make = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage = make(60)
    texts = [None, "", " \n\t", "one", "One", "a b c d", "A b c D", "a b c d e", "a b c d e f"]
    base = make(120)
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.25:
            near = list(base)
            for _ in range(rng.randrange(0, 6)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append(" ".join(near[: rng.randrange(100, 121)]))
        elif kind < 0.4:
            texts.append(" ".join(make(rng.randrange(0, 40)) + passage + make(rng.randrange(0, 30))))
        elif kind < 0.5:
            texts.append(rng.choice([t for t in texts if t]))
        elif kind < 0.6:
            base = make(rng.randrange(5, 200))
            texts.append("  ".join(base))
        else:
            texts.append("\n".join(make(rng.randrange(1, 90))))
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(spark, rows, seed):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, SCHEMA).withColumns({"n_shingles": F.lit("x"), "label": F.lit(1), "node": F.lit(2)}).repartition(5)
    got = jaccard.near_duplicates(df)
    assert rows(got) == sorted(brute.near_duplicates(docs), key=lambda t: [(v is not None, str(v)) for v in t])


def test_large_group_and_small_chunks(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 4)
    monkeypatch.setattr(jaccard, "RUN", 50)
    docs = corpus(7, 120)
    assert rows(jaccard.near_duplicates(spark.createDataFrame(docs, SCHEMA))) == sorted(brute.near_duplicates(docs), key=lambda t: [(v is not None, str(v)) for v in t])


def test_empty_and_repeated_rows(spark, rows):
    assert jaccard.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(map(str, range(30)))
    got = rows(jaccard.near_duplicates(spark.createDataFrame([(5, text), (5, text), (3, text), (9, None), (None, "x y z")], SCHEMA)))
    assert got == sorted([(5, 26, 3), (5, 26, 3), (3, 26, 3), (9, 0, 9), (None, 1, None)], key=lambda t: [(v is not None, str(v)) for v in t])


def test_wanted_sets_are_the_wanted_ones(spark):
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(2000)]
    nodes = [jaccard.node_of(s)[0] for s in shingle_sets(Words(pa.array(texts), lower=True))]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[3]), (7, "another text under the same id"), (7, texts[7])], "id bigint, text string")
    ids = spark.createDataFrame([(nodes[i], i) for i in (0, 7, 1999)] + [(1, 3), (nodes[9], None)], "node bigint, id bigint")
    got = {r["node"]: r["elements"] for r in jaccard.wanted_sets(docs, ids, 5).collect()}
    assert set(got) == {nodes[i] for i in (0, 7, 1999)} and all(len(e) == 8 * 26 for e in got.values())
    none = jaccard.wanted_sets(docs, ids.limit(0), 5)
    assert none.count() == 0


def test_codes_without_left_pairs_are_not_compared_again(spark):
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 2**64, 300, np.uint64))
    sets = [np.unique(np.concatenate([base[:280], rng.integers(0, 2**64, 20, np.uint64)])) for _ in range(6)]
    coarse = [jaccard.fold(s := np.frombuffer(jaccard.parity_sketch(x), np.uint8), len(s) // 2).tobytes() for x in sets]
    nodes = spark.createDataFrame([(i, len(x), c) for i, (x, c) in enumerate(zip(sets, coarse, strict=True))], "node bigint, n bigint, coarse binary")
    # under code 1 three components of one set each: all pairs are told; under code 2 two components of two sets
    rest = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 2, 2), (2, 2, 10), (2, 3, 10), (2, 4, 11), (2, 5, 11)], "key bigint, node bigint, label bigint")
    pairs, left = jaccard.cross_pairs(rest, nodes, True)
    assert {(0, 1), (0, 2), (1, 2)} <= {tuple(r) for r in pairs.collect()} and pairs.count() == 4
    assert [r["key"] for r in left.collect()] == [2]
    every, left = jaccard.cross_pairs(rest, nodes, False)
    assert every.count() == 7 and left.count() == 0


def test_stored_steps_leave_no_shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before = files()
    stored = materialise(spark.range(20_000).repartition(7, "id"), "cleaned")
    assert stored.count() == 20_000 and spark.conf.get(SHUFFLE_CLEANUP, None) in (None, "false")
    until = time.time() + 10
    while (more := {f for f in files() - before if f.endswith(".data")}) and time.time() < until:
        time.sleep(0.2)
    # the count has a shuffle of its own, of one partition a task
    assert sum(os.path.getsize(f) for f in more if os.path.exists(f)) < 10_000


def test_copies_of_all_labels_are_not_broadcast(spark):
    texts = [" ".join(f"w{i % 3000}x{j}" for j in range(12)) for i in range(3100)]
    docs = spark.createDataFrame([*enumerate(texts)], SCHEMA).repartition(4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # a row for each of the 3000 labels is far below it, 32 rows for each are far above
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "500k")
    try:
        kept = corpus_pipeline.near_duplicates(spark, docs, "")
        assert sorted(r["doc_id"] for r in kept.collect()) == [*range(3000)]
        assert "BroadcastHashJoin [label" not in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**64, rng.integers(1, 400), np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**64, rng.integers(0, 30), np.uint64)]))
        s, t = (np.frombuffer(jaccard.parity_sketch(x), np.uint8) for x in (a, b))
        assert jaccard.hamming(s, t) <= len(np.setxor1d(a, b))


def test_linked_sets_share_a_block():
    rng = np.random.default_rng(1)
    bounds = np.array(jaccard.size_bands(4000))
    for _ in range(400):
        n = int(rng.integers(4, 1500))
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        gone = int(rng.integers(0, len(a) // 5 + 1))
        new = int(rng.integers(0, len(a) // 5 + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**64, new, np.uint64)]))
        if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) and len(np.setxor1d(a, b)):
            assert len(np.intersect1d(jaccard.set_codes(a, bounds), jaccard.set_codes(b, bounds)))


def test_shingles_are_those_of_whole_texts():
    texts = ["A b\tC d e f", None, "", "x", "x y z", "é" * 5000, "w " * 9000, "a b c d e f\x0bg", "a\x1cb c d e f"]
    for text, made in zip(texts, shingle_sets(Words(pa.array(texts), lower=True)), strict=True):
        assert len(made) == len(brute.shingles(text))


@pytest.mark.parametrize("seed", [3, 4])
def test_repeats_equal_brute_force(spark, rows, seed):
    docs = corpus(seed)
    rng = random.Random(seed)
    long = " ".join(rng.choice("abcdef") for _ in range(30_000))
    docs += [(len(docs), long), (len(docs) + 1, long[10_000:]), (len(docs) + 2, "a " * 300)]
    df = spark.createDataFrame(docs, SCHEMA).withColumns({"n_words": F.lit("mine"), "starts": F.lit(0), "__id": F.lit(0)}).repartition(6)
    got = repeats.remove_repeats(df).select("doc_id", "n_words", "n_removed", "kept_text")
    assert rows(got) == sorted(brute.remove_repeats(docs), key=lambda t: [(v is not None, str(v)) for v in t])


def test_repeats_with_a_tiny_sketch_lose_nothing(spark, rows):
    docs = corpus(5)
    got = repeats.remove_repeats(spark.createDataFrame(docs, SCHEMA), bits=8).select("doc_id", "n_words", "n_removed", "kept_text")
    assert rows(got) == sorted(brute.remove_repeats(docs), key=lambda t: [(v is not None, str(v)) for v in t])


def test_repeats_edges(spark, rows):
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(f"v{i}" for i in range(70))
    same_id = rows(repeats.remove_repeats(spark.createDataFrame([(1, text), (1, text), (None, text)], SCHEMA)).select("doc_id", "n_removed"))
    assert same_id == [(None, 70), (1, 0), (1, 0)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (2000, 1999), (1999, 2000)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(300)) and got[2000] == 1999
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0
