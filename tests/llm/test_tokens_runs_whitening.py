"""Token ids in Re-Pair files, periodic runs and whitening against plain versions."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from provenor.llm import grammar, runs, tokens, whitening
from provenor.llm.queries import BYTE_MODEL, QUERIES
from provenor.session import working_path

from . import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def byte_model():
    with open(BYTE_MODEL, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def tokenizer(byte_model):
    from tokenizers import Tokenizer

    made = Tokenizer.from_buffer(byte_model)
    made.encode_special_tokens = True
    return made


def test_grammar_gives_the_ids_back():
    rng = np.random.default_rng(1)
    for size, kinds in ((1, 1), (50, 1), (3000, 2), (5000, 40), (4000, 70_000)):
        ids = rng.integers(0, kinds, size)
        ids[size // 2 :] = ids[: size - size // 2]
        last = rng.random(size) < 0.01
        last[-1] = True
        g = grammar.compress(ids, last, kinds)
        expander = grammar.Expander(kinds, g.left, g.right, g.lengths())
        assert (expander.ids(g.symbols) == ids).all()
        ends = np.cumsum(grammar.symbol_lengths(g.symbols, kinds, g.lengths()))
        assert (ends[g.last] - 1 == np.flatnonzero(last)).all()  # no symbol crosses the end of a document
        inside = g.symbols[:-1][~g.last[:-1]].astype(np.int64) * (1 << 32) + g.symbols[1:][~g.last[:-1]]
        pairs, times = np.unique(inside, return_counts=True)
        assert all(a == b for p in pairs[times >= 3].tolist() for a, b in [(p >> 32, p & 0xFFFFFFFF)])  # only overlapping ones are left


def test_pieces_are_encoded_as_whole_texts(byte_model, tokenizer):
    rng = random.Random(5)
    alphabet = [*"abZé'’ñß×÷09.,;:!?-_#  \n\t\r\x0b\x0c\x1c\x1f\x85\xa0　​漢かな한אع😀<|>", "'s", "'ll", "<|endoftext|>", " the", " don't", "  "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)] + [None, "", "x" * 5000, " " * 300]
    got = tokens.Encoder(byte_model, "<u2").encode(pa.array(texts))
    assert [g.tolist() for g in got] == [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def plain_ids(docs, tokenizer):
    start, out = 0, []
    for d, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((d, start, ids))
        start += len(ids)
    return out


def test_ids_are_read_back(spark, byte_model, tokenizer):
    rng = random.Random(2)
    docs = [(k, " ".join(rng.choice(["tea", "rose", "über", "<|endoftext|>", "0"]) for _ in range(rng.randrange(80)))) for k in rng.sample(range(10_000), 300)]
    docs += [(None, "nobody"), (-5, None), (20_000, ""), (20_001, "long words " * 20_000)]
    df = spark.createDataFrame(docs, DOCS).repartition(5).withColumns({"ids": F.lit(1), "start": F.lit("clash"), "range": F.lit(2)})
    folder = working_path(spark, "ids")
    manifest = tokens.write_ids(df, folder, byte_model, shard_ids=2000)
    want = plain_ids(docs, tokenizer)
    got = sorted(((r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in tokens.read_ids(spark, folder).collect()), key=lambda r: r[1])
    assert got == want
    assert manifest.count() > 5 and manifest.agg(F.sum("ids")).first()[0] == sum(len(i) for *_, i in want)
    every = [x for *_, i in want for x in i]
    for a, b in ((0, 1), (1999, 2001), (5000, 9000), (len(every) - 3, len(every)), (7, 7)):
        assert tokens.ids_between(spark, folder, a, b).tolist() == every[a:b]
    assert sum(m["symbols"] for m in manifest.collect()) < len(every) / 3  # the long text repeats


def test_ids_of_repeated_rows_and_of_no_rows(spark, byte_model):
    folder = working_path(spark, "ids")
    tokens.write_ids(spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, None)], DOCS), folder, byte_model)
    rows = tokens.read_ids(spark, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 1, 1] and [len(r["ids"]) // 4 for r in rows] == [1, 2, 2, 2]
    folder = working_path(spark, "ids")
    assert tokens.write_ids(spark.createDataFrame([], DOCS), folder, byte_model).count() == 0
    assert tokens.read_ids(spark, folder).count() == 0


def test_a_changed_file_is_refused(byte_model):
    data = tokens.Shard.build([(1, np.arange(50, dtype=np.int64) % 7)], 50_257).to_bytes()
    with pytest.raises(ValueError):
        tokens.Shard.from_bytes(data[:-1])
    with pytest.raises(ValueError):
        tokens.Shard.from_bytes(b"x" + data[1:])


def test_op11_equals_plain_version(spark, tokenizer):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = {(d, s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, s, i in plain_ids(docs, tokenizer)}
    assert {tuple(r) for r in QUERIES["op11_token_ids"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()} == want


def plain_runs(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, q, n) for (s, n), q in found.items())


def described(w):
    found = plain_runs(w)
    gone = {i for s, q, n in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[2], r[0], r[1])) if found else None
    top = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    return (len(found), *top, brute.sha("".join(f"{s},{n},{q}\n" for s, q, n in found)), brute.sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def random_words(rng):
    w = [str(rng.randrange(rng.choice([1, 2, 3, 40]))) for _ in range(rng.randrange(150))]
    if w and rng.random() < 0.6:
        a = rng.randrange(len(w))
        p = 1 + (len(w) - a) // rng.randrange(3, 11)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


@pytest.mark.parametrize("finder", ["hashes", "names"])
def test_runs_equal_plain_version(monkeypatch, finder):
    if finder == "names":
        monkeypatch.setattr(runs, "Repeats", runs.Names)
    rng = random.Random(3)
    for _ in range(60):
        docs = [random_words(rng) for _ in range(rng.randrange(1, 6))]
        first = np.cumsum([0, *map(len, docs)])
        codes = np.array([zlib.crc32(x.encode()) * 0x9E3779B97F4A7C15 % (1 << 64) for d in docs for x in d], np.uint64)
        d, s, n, q = runs.find_runs(codes, first)
        for k, w in enumerate(docs):
            assert sorted(zip((s - first[k])[d == k].tolist(), q[d == k].tolist(), n[d == k].tolist(), strict=True)) == plain_runs(w)


def test_hashes_that_lie_are_noticed(monkeypatch):
    thue = [0]
    while len(thue) < 8192:
        thue += [1 - x for x in thue]
    words = thue + thue[4096:8192] + [2] + thue[:4096]
    codes = np.array(words, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7)
    _, s, n, q = runs.find_runs(codes, np.array([0, len(words)]))
    for a, b, c in zip(s, n, q, strict=True):
        assert (codes[a : a + b - c] == codes[a + c : a + b]).all()


def test_runs_of_edge_cases(spark):
    texts = [None, "", " \n", "a", "a " * 11, "a " * 12, "a b " * 50_000, "x y z w v u " * 2, "x y z w v u t " * 2 + "x"]
    df = spark.createDataFrame([(1, t) for t in texts] + [(None, "a " * 12)], DOCS).withColumns({"runs": F.lit(0), "start": F.lit("clash")})
    rows = runs.periodic_runs(df).collect()
    assert [(r["n_words"], r["n_runs"], r["length"], r["period"]) for r in rows] == [
        (0, 0, None, None), (0, 0, None, None), (0, 0, None, None), (1, 0, None, None), (11, 0, None, None), (12, 1, 12, 1), (100_000, 1, 100_000, 2), (12, 1, 12, 6), (15, 1, 15, 7), (12, 1, 12, 1),
    ]
    assert [r["collapsed"] for r in rows][5:8] == ["a", "a b", "x y z w v u"]
    assert runs.periodic_runs(spark.createDataFrame([], DOCS)).count() == 0


def test_op12_equals_plain_version(spark):
    want = set()
    for d, t in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        w = brute.words(t)
        h = zlib.crc32(str(d).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        want.add((d, *described(w)))
    cols = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = {tuple(r) for r in QUERIES["op12_periodic_runs"](spark, SF).select(*cols).collect()}
    assert got == want and sum(r[1] > 0 for r in got) > 10


def plain_whitening(vectors, k):
    x = np.array(vectors, np.int64)
    n, s = len(x), x.sum(0)
    centred = (n * x - s) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    gaps = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    return gaps, centred @ vectors[:, :k] / np.sqrt(values[:k]), values / values.sum()


def test_op13_equals_plain_version(spark):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    keys = sorted(rows)
    gaps, white, explained = plain_whitening([np.floor(64 * np.array(rows[k], float)) + 1_000_000 for k in keys], 32)
    got = QUERIES["op13_whitening"](spark, SF).toPandas()
    assert len(got) == 32 * len(keys) and set(got["n"]) == {len(keys)} and got["identity_error"].max() < 1e-9
    assert dict(zip(got["vec_id"], got["deviation"], strict=True)) == dict(zip(keys, gaps, strict=True))
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[keys].to_numpy()
    assert np.abs(np.abs(table) - np.abs(white)).max() < 1e-8
    assert (np.sign(table[0]) * np.sign(white[0]) * table * np.sign(white) >= -1e-9 * np.abs(table)).mean() > 0.99  # one sign per component
    assert np.allclose(got.groupby("component")["explained"].first().to_numpy(), explained[:32], rtol=1e-6)


def test_vectors_that_cannot_be_used(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.5, -1.0]), (None, [3.0, 1.0]), (3, None), (4, []), (5, [1.0, nan]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [1e30, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, x array<double>").withColumn("whitened", F.lit("clash"))
    kept = whitening.usable(whitening.usable(df, "x").withColumn("x", whitening.scaled(F.col("x"))), "x")
    made = whitening.whiten(kept, "vec_id", "x")
    got = made.rows.collect()
    assert made.n == 4 and len(got) == 4 and made.identity_error < 1e-9 and all(len(r["whitened"]) == 2 for r in got)
    assert len({tuple(r["whitened"]) for r in got if r["vec_id"] == 1}) == 1


def test_vectors_without_variance_and_no_vectors(spark):
    flat = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0]) for k in range(5)], "vec_id bigint, x array<double>"), "vec_id", "x")
    rows = flat.rows.collect()
    assert all(r["whitened"][1] is None and r["whitened"][0] is not None for r in rows) and flat.identity_error < 1e-9
    same = whitening.whiten(spark.createDataFrame([(1, [2.0, 2.0])] * 3, "vec_id bigint, x array<double>"), "vec_id", "x")
    assert same.identity_error is None and all(r["whitened"] == [None, None] for r in same.rows.collect())
    none = whitening.whiten(spark.createDataFrame([], "vec_id bigint, x array<double>"), "vec_id", "x")
    assert none.n == 0 and none.rows.count() == 0
