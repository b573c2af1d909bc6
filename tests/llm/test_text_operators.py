"""Quality rules, SentencePiece, language-model scores, latent search and licences."""

import base64
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from provenor.llm import fertility, interpolation, latent, licences, spm

from . import brute

DOCS = "doc_id bigint, text string, lang string"
TRICKY = [
    (0, None, "en"), (1, "", "en"), (2, " \n\t ", None), (3, "one two", "xx"), (4, "The same words. " * 40, "en"), (5, "line a\nline b\nline a\n\n  \nline a", "de"),
    (6, "ü€𝄞 ñandú 漢字 漢字 mixed | text # with * symbols < and > so & on", "fr"), (7, "x" * 30_000, "en"), (8, "漢字かな交じり文 " * 12 + "終わり", "ja"),
    (9, "a b c d e f g h i j k l m n o p", None), (9, "a b c d e f g h i j k l m n o p", None), (None, "some words with a null id and nothing else to say here", "en"),
]


def test_quality_base_equals_brute_force(spark, model):
    df = spark.createDataFrame(TRICKY, DOCS).withColumn("kept", F.lit("clash"))
    got = fertility.quality_rules(df, model).collect()
    assert len(got) == len(TRICKY)
    for r in got:
        want = brute.quality(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert not (r["kept"] and r["base_failed"])
    assert fertility.quality_rules(spark.createDataFrame([], DOCS), model).count() == 0


def test_fertility_measures(spark, model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    text = "Plain words of a sentence and 漢字 plus 𝄞 for bytes, again plain words"
    got = fertility.quality_rules(spark.createDataFrame([(1, text, "en")], DOCS), model).first()
    ids = [i for w in brute.words(text) for i in sp.encode(w)]
    p = [n / len(ids) for n in Counter(ids).values()]
    assert got["chars_per_token"] == pytest.approx(got["word_chars"] / len(ids))
    assert got["byte_share"] == pytest.approx(sum(map(sp.IsByte, ids)) / len(ids))
    assert got["token_entropy"] == pytest.approx(-sum(x * math.log2(x) for x in p))
    assert got["byte_share"] > 0


def test_encoded_and_random_strings_are_not_kept(spark, model):
    rng = random.Random(9)
    junk = [
        lambda: base64.b64encode(rng.randbytes(30)).decode(), lambda: rng.randbytes(16).hex(), lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)),
    ]
    docs = [(i, " ".join(junk[i % 3]() for _ in range(10 + i)), ["en", "de", "fr", "es", "it", None][i // 3 % 6]) for i in range(90)]
    prose = [
        ("The committee met on Tuesday to discuss the new budget, and most members agreed that the plan needs further work before the vote.", "en"),
        ("Der Ausschuss hat am Dienstag über den neuen Haushalt beraten, und die meisten Mitglieder waren sich einig, dass noch Arbeit nötig ist.", "de"),
        ("Le comité s'est réuni mardi pour discuter du nouveau budget, et la plupart des membres pensent que le projet doit encore être revu.", "fr"),
        ("El comité se reunió el martes para discutir el nuevo presupuesto, y la mayoría de los miembros cree que falta trabajo antes del voto.", "es"),
        ("Komitet spotkał się we wtorek, aby omówić nowy budżet, a większość członków uznała, że plan wymaga dalszej pracy przed głosowaniem.", None),
        ("Комитет собрался во вторник, чтобы обсудить новый бюджет, и большинство членов согласилось, что план требует доработки.", None),
    ]
    docs += [(1000 + i, t, lang) for i, (t, lang) in enumerate(prose)]
    kept = {r["doc_id"] for r in fertility.quality_rules(spark.createDataFrame(docs, DOCS), model).where("kept").collect()}
    assert kept == {1000 + i for i in range(len(prose))}


def unigram_model(model):
    """The same pieces for the library's unigram search, which adds scores in single precision: those of -1e9 would blur all others."""
    pb2 = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb2.ModelProto()
    proto.ParseFromString(model)
    proto.trainer_spec.model_type = 1
    for piece in proto.pieces:
        piece.score = max(piece.score, -40_000.0)
    return proto.SerializeToString()


def test_encoding_equals_the_library(spark, model):
    import sentencepiece

    unigram = unigram_model(model)
    sp = sentencepiece.SentencePieceProcessor(model_proto=unigram)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("text")).where("text <> ''")
    for r in spm.encode(lines, unigram).collect():
        assert r["ids"] == sp.encode(r["text"])
    for r in spm.decode(spm.encode(docs, model), model).collect():
        assert r["decoded"] == r["text"] == sp.decode(r["ids"])


def test_chunked_scan_equals_one_piece(spark, model):
    import sentencepiece

    model = unigram_model(model)
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(1)
    texts = [t for _, t, _ in TRICKY] + ["".join(rng.choice("aeinrst") for _ in range(900)), "  two  spaces   and\n\nlines " * 20, "x y " * 60]
    df = spark.createDataFrame([(i, t, "ids") for i, t in enumerate(texts)], "doc_id bigint, text string, doc string")
    scores = {i: sp.GetScore(i) for i in range(sp.GetPieceSize())}
    for r in spm.decode(spm.encode(df, model, chunk=37), model).collect():
        want = texts[r["doc_id"]]
        assert r["decoded"] == want and r["doc"] == "ids"
        if want:
            whole = sp.encode(want)
            real = lambda ids: sum(scores[i] for i in ids if not sp.IsByte(i))
            assert real(r["ids"]) == pytest.approx(real(whole)) and (r["ids"] == whole or " " not in want)
        else:
            assert r["ids"] == ([] if want == "" else None)
    assert spm.encode(spark.createDataFrame([], "doc_id bigint, text string"), model).count() == 0


def test_units_are_solved_once(model):
    v = spm.Vocabulary(model)
    texts = pa.array(["".join(f"▁w{i}" for i in range(a, a + 5_000)) for a in range(0, 150_000, 5_000)])
    for text in texts:
        v.encode_all(pa.array([text.as_py()]))
    v.segment = None  # more than 100,000 units are still known
    ids, ends = v.encode_all(texts)
    assert v.decode_all(ids, ends[1:]).to_pylist() == [t.as_py()[1:].replace("▁", " ") for t in texts]


def test_little_room_changes_no_ids(model, monkeypatch):
    texts = [t for _, t, _ in TRICKY] + ["\n\n a\n b  c", "▁", "▁▁x▁", "é☃" * 40, "日本語 " * 9, "\x00a \x00"]
    escaped = [t if not t else spm.SPACE + t.replace(" ", spm.SPACE) for t in texts]
    want = spm.Vocabulary(model).encode_all(pa.array(escaped, pa.string()))
    monkeypatch.setattr(spm, "REMEMBERED", 4)
    monkeypatch.setattr(spm, "REMEMBERED_IDS", 9)
    monkeypatch.setattr(spm, "FEW", 0)
    v = spm.Vocabulary(model)
    found = [v.encode_all(pa.array([t], pa.string()))[0].tolist() for t in escaped]
    assert found == [want[0][a:b].tolist() for a, b in zip(want[1][:-1], want[1][1:], strict=True)]
    units = [[] if t is None else v.unit.findall(t) for t in escaped]
    assert found == [[i for u in own for i in v.encode_unit(u)] for own in units]
    assert v.decode_all(*[want[0], want[1][1:]]).to_pylist() == [(t or "").replace("▁", " ") for t in texts]


def test_numbers_of_keys():
    rng = np.random.default_rng(3)
    keys = np.unique(np.concatenate([np.arange(300, dtype=np.uint64), rng.integers(0, 2**64, 700, np.uint64)]))
    table = spm.Numbers(len(keys))
    for a in range(0, len(keys), 100):
        assert (table.get(keys[a:]) == -1).all()
        table.put(keys[a : a + 100], np.arange(a, min(a + 100, len(keys)), dtype=np.int32))
    assert (table.get(keys) == np.arange(len(keys))).all() and (table.get(rng.integers(2**40, 2**50, 500).astype(np.uint64)) == -1).all()


def test_sketch_of_stored_terms_is_that_of_dense_rows(spark):
    rng = random.Random(8)
    texts = [None, "", " \n"] + [" ".join(rng.choices([f"k{i}" for i in range(300)], [1 / (i + 1) for i in range(300)], k=rng.randrange(1, 400))) for _ in range(150)]
    words = latent.Words(pa.array(texts, pa.string()), lower=True)
    dense = np.zeros((len(texts), latent.TERMS), np.int64)
    np.add.at(dense, (words.owner(), latent.terms(words)), 1)
    stored = latent.stored_terms(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    assert stored.where("part < 0").count() == len(texts)
    idf = latent.inverse_frequencies(stored, len(texts), [])
    assert np.allclose(idf, np.log((len(texts) + 1) / ((dense > 0).sum(axis=0) + 1)))
    start = latent.start_vectors(4)
    starts, ends = latent.windows_of(words, latent.SHORT * latent.BLOCK)
    assert (latent.window_starts(words.counts(), latent.SHORT * latent.BLOCK) == starts).all()
    rows = np.zeros((len(starts), latent.TERMS))
    for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
        np.add.at(rows[i], latent.terms(words)[a:b], 1.0)
    rows *= idf
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    want = rows.T @ (rows @ start)
    assert np.allclose(latent.corpus_sketch(stored, idf, start, stored), want, atol=1e-4 * np.abs(want).max())


def test_matrices_combine_associatively(model):
    v = spm.Vocabulary(model)
    rng = random.Random(2)
    text = "".join(rng.choice("abceinorst▁") for _ in range(200))
    parts = [(text[a : a + 20 + v.longest - 1], min(20, len(text) - a)) for a in range(0, len(text), 20)]
    matrices = [v.matrix(t, n) for t, n in parts]
    left = spm.scan_all(matrices)
    right = spm.combine(spm.scan_all(matrices[:3]), spm.combine(spm.scan_all(matrices[3:7]), spm.scan_all(matrices[7:])))
    best, _ = v.forward(text, {0: 0.0}, len(text))
    assert np.array_equal(left, right) and left[0, 0] == best[-1]


def corpus(n, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(60)]
    return [(i, " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(60)], k=rng.randrange(0, 50)))) for i in range(n)]


def brute_scores(docs, weights, told):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    tokens = {i: [*brute.words(t, lower=True), None] for i, t in docs}
    counts = Counter(w for i, t in docs if not held[i] for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    keep = told(counts)
    name = lambda w: w if w in keep else "rare"
    c1, c12 = Counter(), Counter()
    for i, _ in docs:
        if not held[i]:
            c1.update(map(name, tokens[i]))
            c12.update(zip(map(name, [None, *tokens[i][:-1]]), map(name, tokens[i]), strict=True))
    out = {}
    for i, _ in docs:
        total = base = 0.0
        for a, b in zip([None, *tokens[i][:-1]], tokens[i], strict=True):
            share = 1.0 if b in keep else 1 / (v - len(keep) + 1)
            a, q = name(a), name(b)
            total += math.log10(weights[0] * share * c12[a, q] / max(c1[a], 1) + weights[1] * share * c1[q] / n + weights[2] / (v + 1))
            base += math.log10((counts[b] + 1) / (n + v + 1))
        out[i] = (held[i], len(tokens[i]), sum(counts[w] > 0 for w in tokens[i]), n, base, total)
    return out


@pytest.mark.parametrize("vocabulary", [1 << 20, 20])
def test_scores_equal_brute_force(spark, monkeypatch, vocabulary):
    weights = (0.5, 0.3, 0.2)
    monkeypatch.setattr(interpolation.Model, "learn", lambda m, cells, times: setattr(m, "weights", np.tile(weights, (interpolation.BUCKETS, 1))))
    docs = [*corpus(120), (500, None), (501, ""), (502, "Unheard T1 wordsé here"), (503, "t1 " * 3000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"score": F.lit("x"), "mark": F.lit(1), "held": F.lit(2)}).repartition(4)

    def told(counts):
        if vocabulary > 60:
            return set(counts)
        least = lambda c: math.floor(math.log2(c) * 64)
        kept, total = set(), 0
        for b in sorted({least(c) for c in counts.values()}, reverse=True):
            own = {w for w, c in counts.items() if least(c) == b}
            if total + len(own) > vocabulary:
                break
            kept, total = kept | own, total + len(own)
        return kept

    want = brute_scores(docs, weights, told)
    got = interpolation.score(df, F.crc32(F.col("doc_id").cast("string")) % 7 == 2, vocabulary=vocabulary).collect()
    assert len(got) == len(docs)
    for r in got:
        held, n, known, train, base, total = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, train)
        assert r["base_score"] == pytest.approx(base, abs=1e-6) and r["score"] == pytest.approx(total, abs=1e-6)


def test_every_type_has_its_own_counts(spark, monkeypatch):
    monkeypatch.setattr(interpolation.Model, "learn", lambda m, cells, times: setattr(m, "weights", np.tile((0.5, 0.3, 0.2), (interpolation.BUCKETS, 1))))
    docs = spark.range(0, 1_200, 1, 4).select(
        F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(0, 999), i -> concat('w', id * 1000 + i)), ' ')").alias("text"), F.lit(False).alias("held")
    )
    probes = spark.createDataFrame([(-1, "w5000 w5001", True), (-2, "w5001 w5000", True), (-3, "unheard w5000", True)], "doc_id bigint, text string, held boolean")
    got = {r["doc_id"]: r["score"] for r in interpolation.score(docs.unionByName(probes), F.col("held")).where("doc_id < 0").collect()}
    types, n = 1_200_001, 1_200 * 1001
    p = lambda c12, c1, c2: 0.5 * c12 / max(c1, 1) + 0.3 * c2 / n + 0.2 / (types + 1)
    want = {
        -1: [p(1, 1200, 1), p(1, 1, 1), p(0, 1, 1200)], -2: [p(0, 1200, 1), p(0, 1, 1), p(0, 1, 1200)], -3: [p(0, 1200, 0), p(0, 0, 1), p(0, 1, 1200)],
    }
    assert got == {d: pytest.approx(sum(map(math.log10, x)), abs=1e-9) for d, x in want.items()}


def test_scores_of_repeated_and_no_rows(spark):
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b"), (4, None)], "doc_id bigint, text string")
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["score"], 9)) for r in interpolation.score(df, held).collect())
    assert len(got) == 4 and got[0] == got[1] and all(math.isfinite(r[3]) for r in got)
    assert interpolation.score(spark.createDataFrame([], "doc_id bigint, text string"), held).count() == 0


def brute_weights(docs):
    """Interpolation weights per context bucket by plain expectation-maximisation over bigrams, each text's own counts deleted."""
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    tokens = {i: [*brute.words(t, lower=True), None] for i, t in docs}
    own1 = {i: Counter(tokens[i]) for i in tokens}
    own2 = {i: Counter(zip([None, *tokens[i][:-1]], tokens[i], strict=True)) for i in tokens}
    c1, c12 = sum((own1[i] for i in tokens if not held[i]), Counter()), sum((own2[i] for i in tokens if not held[i]), Counter())
    n, v, cells = sum(c1.values()), len(c1), {}
    for i in tokens:
        if held[i]:
            continue
        for (a, b), times in own2[i].items():
            context = c1[a] - own1[i][a]
            p2 = (c12[a, b] - times) / max(context, 1)
            p1 = (c1[b] - own1[i][b]) / max(n - len(tokens[i]), 1)
            near = [float(interpolation.value(interpolation.binned(np.array([p])))[0]) for p in (p2, p1)]
            cells.setdefault(max(context, 1).bit_length() - 1, []).append((*near, 1 / (v + 1), times))

    def fitted(rows, w):
        for _ in range(60):
            sums = np.zeros(3)
            for *p, times in rows:
                part = np.array(p) * w
                sums += times * part / part.sum()
            w = np.maximum(sums, 1e-6 * sum(r[3] for r in rows))
            w = w / w.sum()
        return w

    whole = fitted([r for rows in cells.values() for r in rows], np.array([0.6, 0.3, 0.1]))
    return {b: fitted(rows, whole) for b, rows in cells.items()}


def test_learned_weights_equal_brute_force(spark, monkeypatch):
    docs, learned = corpus(40), {}
    learn = interpolation.Model.learn
    monkeypatch.setattr(interpolation.Model, "learn", lambda m, cells, times: (learn(m, cells, times), learned.update(enumerate(m.weights)))[0])
    interpolation.score(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), F.crc32(F.col("doc_id").cast("string")) % 7 == 2).count()
    for bucket, weights in brute_weights(docs).items():
        assert learned[bucket] == pytest.approx(weights, abs=1e-6)


def test_held_out_texts_teach_nothing(spark):
    docs = corpus(60)
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    changed = [(i, "quite other words " * 9 if zlib.crc32(str(i).encode()) % 7 == 2 else t) for i, t in docs]
    run = lambda rows: {r["doc_id"]: r["score"] for r in interpolation.score(spark.createDataFrame(rows, "doc_id bigint, text string"), held).where("not held_out").collect()}
    before, after = run(docs), run(changed)
    assert before.keys() == after.keys() and all(before[k] == pytest.approx(after[k], abs=1e-9) for k in before)


def test_rows_may_come_in_another_order_each_time(spark):
    docs = spark.createDataFrame(corpus(300), "doc_id bigint, text string")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2

    def shuffled(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.Table.from_batches([b]).take(np.random.default_rng().permutation(b.num_rows)).combine_chunks().to_batches()[0] if b.num_rows else b

    got = {r["doc_id"]: r["score"] for r in interpolation.score(docs.coalesce(2).mapInArrow(shuffled, docs.schema), held).collect()}
    want = {r["doc_id"]: r["score"] for r in interpolation.score(docs, held).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_learned_weights_raise_held_out_likelihood():
    m = interpolation.Model(np.array([1, 2], np.uint64), np.array([50, 50]), 100, 2)
    p2, p1 = np.array([0.9, 0.0, 0.1]), np.array([0.1, 0.2, 0.1])
    cells = (5 * interpolation.BINS + interpolation.binned(p2)) * interpolation.BINS + interpolation.binned(p1)
    times = np.array([80.0, 10.0, 10.0])

    def likelihood(w):
        return float((times * np.log(w[0] * p2 + w[1] * p1 + w[2] / 3)).sum())

    before = likelihood(m.weights[5])
    m.learn(cells, times)
    grid = max(likelihood((a, b, 1 - a - b)) for a in np.linspace(0.01, 0.98, 98) for b in np.linspace(0.01, 0.98, 98) if a + b < 1)
    assert likelihood(m.weights[5]) > before and likelihood(m.weights[5]) > grid - 0.5 and m.weights[5].sum() == pytest.approx(1)


def test_leaks_are_found_and_clean_texts_left(spark):
    rng = random.Random(4)
    vocabulary = [f"n{i}" for i in range(3000)]
    make = lambda k: rng.choices(vocabulary, k=k)
    items = [(i, " ".join(make(rng.randrange(12, 150)))) for i in range(40)] + [(98, None), (99, "")]
    docs, planted = [], set()
    for i in range(200):
        words = make(rng.randrange(0, 400))
        if i % 4 == 0:
            item = i // 4 % 40
            leak = items[item][1].split()
            if i % 8 == 0:  # a paraphrase: some words replaced, none of the last ones
                leak = [rng.choice(vocabulary) if rng.random() < 0.2 and k < len(leak) - 8 else w for k, w in enumerate(leak)]
            at = rng.randrange(0, len(words) + 1)
            words[at:at] = leak
            planted.add((i, item))
        docs.append((i, " ".join(words)))
    docs += [(900, None), (901, ""), (902, "n1 " * 5000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    found = {(r["doc_id"], r["item_id"]) for r in latent.contaminated(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert len(found & planted) >= 0.95 * len(planted) and not found - planted
    assert latent.contaminated(df, spark.createDataFrame([], "item_id bigint, text string")).count() == 0
    assert latent.contaminated(spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0


def test_leaks_do_not_depend_on_the_cosine(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(2000)]
    weights = [1 / (k + 3) for k in range(2000)]
    make = lambda k: rng.choices(vocabulary, weights, k=k)
    items = [(i, " ".join(make(rng.choice([5, 8, 9, 15, 24, 32, 33, 50, 64])))) for i in range(3000)]
    docs = []
    for i in range(120):
        words, leak = make(100), items[i * 25][1].split()
        leak = [rng.choice(vocabulary) if i % 3 and rng.random() < 0.35 and k < len(leak) - 8 else w for k, w in enumerate(leak)]
        docs.append((i, " ".join([*words[: i % 50], *leak, *words[i % 50 :]])))
    got = latent.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    numbers = {w: i for i, w in enumerate(vocabulary)}
    coded = [(i, [numbers[w] for w in t.split()]) for i, t in items]
    given = [(i, len(w), latent.masks_of(w), latent.masks_of(w[-8:])) for i, w in coded]
    counts = np.zeros((len(items), len(vocabulary)), np.int32)
    for i, w in coded:
        np.add.at(counts[i], w, 1)
    least = np.array([n if n <= 8 else max(8, 0.6 * n) for _, n, *_ in given])
    want = set()
    for d, text in docs:
        words = [numbers[w] for w in text.split()]
        for at in range(0, len(words), 16):
            for span in (48, 96):
                window = words[at : at + span]
                for i in np.flatnonzero(counts[:, np.unique(window)].sum(axis=1) >= least):
                    item, n, mask, last = given[i]
                    if (span == 48) == (n <= 32) and latent.lcs(mask, n, window) >= least[i] and latent.lcs(last, min(n, 8), window) >= min(n, 8) / 2:
                        want.add((d, item))
    assert len(want) >= 100 and {(r["doc_id"], r["item_id"]) for r in got} == want


def test_bit_parallel_lcs():
    rng = random.Random(5)
    for _ in range(200):
        a, b = rng.choices(range(8), k=rng.randrange(0, 70)), rng.choices(range(8), k=rng.randrange(0, 90))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert latent.lcs(latent.masks_of(a), len(a), b) == table[-1][-1]


def test_licences(spark):
    rng = random.Random(6)
    noise = [" ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(3, 60))) for _ in range(300)]
    classifier = licences.fit(spark, noise)
    examples = licences.examples(licences.TEMPLATES, noise[:50], 10, seed=77)
    docs = [(i, f"{rng.choice(noise)}\n{text}\n{rng.choice(noise)}") for i, (text, _) in enumerate(examples)]
    clean = [(10_000 + i, "\n".join(rng.choices(noise, k=4))) for i in range(300)] + [(20_000, None), (20_001, ""), (20_002, "w " * 9000), (20_003, "\n\n")]
    df = spark.createDataFrame(docs + clean, "doc_id bigint, text string").withColumn("family", F.lit("clash"))
    found = {(r["doc_id"], r["family"]) for r in licences.scan(df, classifier).collect()}
    right = {(i, f) for i, (_, f) in enumerate(examples)}
    assert len(found & right) >= 0.95 * len(right)
    assert not [x for x in found if x[0] >= 10_000]
    assert licences.scan(spark.createDataFrame([], "doc_id bigint, text string"), classifier).count() == 0


WRAPPED = {
    "GPL": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "LGPL": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "BSD": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:""",
    "Apache": """you may not use this file except in compliance
with the License. You may obtain a copy of the
License at apache.org/licenses/LICENSE-2.0""",
}


def test_wrapped_notices(spark):
    rng = random.Random(7)
    noise = [" ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(3, 60))) for _ in range(300)]
    classifier = licences.fit(spark, noise)
    docs, right = [], set()
    for family, notice in WRAPPED.items():
        lines = notice.split("\n")
        for text in (notice, "\n".join(f" * {x}" for x in lines), "\n".join(f"# {x}" for x in lines), f"{noise[1]}\n\n{notice}\n\n{noise[2]}"):
            right.add((len(docs), family))
            docs.append((len(docs), text))
    docs += [(1000 + i, "\n".join(rng.choices(noise, k=6))) for i in range(50)]
    found = licences.scan(spark.createDataFrame(docs, "doc_id bigint, text string"), classifier).collect()
    assert {(r["doc_id"], r["family"]) for r in found} == right and {r["n_paragraphs"] for r in found} == {1}


def test_latent_space_is_fitted_on_all_documents(spark):
    rnd = np.random.default_rng(5)
    texts = [None, "", *(" ".join(f"w{int(x)}" for x in rnd.zipf(1.4, int(rnd.integers(1, 200))) % 900) for _ in range(600))]
    items = [np.unique(rnd.integers(0, latent.TERMS, 30)) for _ in range(5)]
    idf = rnd.random(latent.TERMS).astype(np.float32)
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").repartition(7)
    start = latent.start_vectors(16)
    sketch = latent.corpus_sketch(df, idf, start)
    rows = []
    for text in texts:
        term = latent.terms(latent.Words(pa.array([text], pa.string()), lower=True))
        for at in range(0, len(term), 48):
            row = np.bincount(term[at : at + 48], minlength=latent.TERMS) * idf.astype(float)
            rows.append(row / np.linalg.norm(row))
    a = np.array(rows)
    assert np.abs(sketch - a.T @ (a @ start)).max() < 1e-3
    space = latent.latent_space(sketch, start, items, idf, 2.0)
    own = np.array([np.bincount(i, minlength=latent.TERMS) * idf.astype(float) for i in items])
    both = np.vstack([a, np.sqrt(2.0) * own / np.linalg.norm(own, axis=1, keepdims=True)])
    best = (np.linalg.svd(both, compute_uv=False)[:16] ** 2).sum()
    assert np.abs(space.T @ space - np.eye(16)).max() < 1e-4 and ((both @ space) ** 2).sum() > 0.6 * best


def test_projection_sums_ranges_of_any_length():
    rnd = np.random.default_rng(6)
    space, term = rnd.random((latent.TERMS, 8)).astype(np.float32), rnd.integers(0, latent.TERMS, 30000)
    starts = np.concatenate([[0], np.sort(rnd.choice(np.arange(1, 30000), 9000, replace=False))])
    assert np.allclose(latent.project(term, starts, space), np.add.reduceat(space[term], starts, axis=0), atol=1e-5)
