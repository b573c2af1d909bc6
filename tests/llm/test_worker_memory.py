"""What a Python task holds follows a block of a slice, not the slice; wide rows reach it in small batches and once."""

import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline
from provenor.llm import fertility, repeats, words
from provenor.session import materialise


def mixed_texts(size):
    rng = np.random.default_rng(5)
    some = ["", "a", "  lead and trail\t\n", "é" * 300_000 + " " + "x" * (words.BLOCK + 7), " ".join(f"w{k}" for k in rng.integers(0, 90_000, size // 6))]
    return pa.array([*some, None, "last"], pa.string())


def test_hashes_in_blocks_are_those_of_single_words():
    made = words.Words(mixed_texts(2 << 20), lower=True)
    parts = [p for t in mixed_texts(2 << 20).to_pylist() for p in (t or "").encode().split()]
    assert len(parts) == len(made.hash)
    for k in [*range(6), *range(len(parts) - 1, 0, -997)]:
        assert words.Words(pa.array([parts[k].decode()]), lower=True).hash[0] == made.hash[k]
    for n in (1, 5, 50, words.BLOCK + 3):
        runs = words.run_hash(made.hash, n)
        assert len(runs) == max(0, len(made.hash) - n + 1)
        for k in range(0, len(runs), 9973):
            assert words.run_hash(made.hash[k : k + n], n)[0] == runs[k]


def test_hashing_a_slice_takes_blocks():
    text = pa.array(["some words of a text " * (words.SLICE_BYTES // 21)], pa.string())
    words._POWERS.clear()
    tracemalloc.start()
    words.run_hash(words.Words(text, lower=True).hash, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20  # 250 MB when whole slices were summed
    assert sum(x.nbytes for x in words._POWERS.values()) <= 8 << 20  # 67 MB


def test_known_words_are_held_in_arrays(model):
    held = fertility.Fertility(model, 50_000)
    texts = [" ".join(f"{k:x}word" for k in range(a, a + 30_000)) for a in (0, 20_000, 90_000, 0)]
    for text in texts:
        some = words.Words(pa.array([text]), lower=False)
        ids, sizes = held.ids(held.know(some))
        each = held.sp.encode(text.split())
        assert ids.tolist() == [i for x in each for i in x] and sizes.tolist() == list(map(len, each))
    kept = [held.numbers.keys, held.numbers.values, held.begin, held.pool]
    assert held.count <= 50_000 and sum(x.nbytes for x in kept) < 5 << 20
    assert fertility.Fertility(model, 10).know(words.Words(pa.array(["one two " + texts[0]]), lower=False)).max() == 30_001


def test_rows_reach_tasks_in_small_batches_of_a_stored_step(spark):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "bytes": [batch.nbytes]})

    wide = spark.range(0, 8000, numPartitions=1).selectExpr("id", "repeat('x', 4000) AS text")
    rows = materialise(wide.mapInArrow(run, "n long, bytes long")).collect()
    assert sum(r["n"] for r in rows) == 8000
    assert max(r["bytes"] for r in rows) < 9 << 20  # 32 MB before
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None


def sent_columns(df):
    """The columns that go to Python tasks."""
    plan = df._jdf.queryExecution().analyzed().toString().split("\n")
    return [below for line, below in zip(plan, plan[1:], strict=False) if "MapInArrow" in line]


def test_texts_go_to_tasks_once(spark, model):
    docs = spark.createDataFrame([(1, "en", "a text of a few words", 21)], "doc_id long, lang string, text string, n_chars long")
    (sent,) = sent_columns(fertility.quality_rules(docs, model))
    assert sent.count("text") == 1
    cut = repeats.remove_repeats(docs)
    assert [r["kept_text"] for r in cut.collect()] == ["a text of a few words"]
    assert sum(line.count("text") for line in sent_columns(cut) if "__in_text" in line) == 1
    assert all("__text" not in line for line in cut._jdf.queryExecution().optimizedPlan().toString().split("\n"))
    ids = corpus_pipeline.token_ids(spark, docs, "")
    assert ids.columns == ["doc_id", "n_ids", "ids"] and ids.first()["n_ids"] > 0
    assert all("__in_text" not in line for line in sent_columns(ids))
