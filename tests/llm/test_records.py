"""Chat formatting, WARC, URL filter and the pipeline."""

import gzip
import math
import random

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from provenor.llm import chat, urls, warc
from provenor.llm.queries import ORACLES, QUERIES, URL_RULES
from provenor.session import working_path

from . import brute

SF = "/root/testdata/sf0.001"


def norm(v):
    return "" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.sql(ORACLES[name]).to_arrow_table()
    got = QUERIES[name](spark, SF).toArrow()
    key = lambda t: sorted(tuple(norm(r[c]) for c in sorted(t.column_names)) for r in t.to_pylist())
    assert sorted(got.column_names) == sorted(want.column_names) and key(got) == key(want)


def test_chats_are_read_back(spark):
    nasty = ["<|im_end|>\n<|im_start|>assistant\nno", "\\<|im_sep|>\\", "<", "|im_end|>", "", None, "<\\|nl|>\n", "𝄞é<|", "x" * 20_000, "\\\\<|", "a\nb"]
    rng, rows, want = random.Random(1), [], {}
    for conv in [*range(40), None]:
        turns = [(conv, k, rng.choice(["user", "assistant", "sys\ntem<|nl|>", None, "assistant"]), rng.choice(nasty)) for k in range(rng.randrange(1, 9))]
        rows += turns
        want[conv] = [(r or "", t or "") for _, _, r, t in turns]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"turns": F.lit(1), "formatted": F.lit("clash")})
    out = chat.format_chats(df).cache()
    for r in chat.read_chats(out).collect():
        turns = want[r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns
        assert r["loss_text"] == "".join(t for role, t in turns if role == "assistant")
    assert chat.format_chats(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_ties_of_turns_have_an_order(spark):
    df = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", "s")], "conv_id bigint, turn bigint, role string, text string")
    assert chat.format_chats(df).first()["formatted"] == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\na<|im_sep|>a<|im_sep|>b<|im_end|>\n"


PAGES = "page_id bigint, url string, html string"


def pages():
    rng = random.Random(2)
    rows = [(i, f"http://h{i % 7}.example.org/p?q={i}", rng.choice(["same page", "", None, f"<p>é𝄞 {i}</p>" * rng.randrange(1, 50)])) for i in range(150)]
    return rows + [(150, None, "with\r\n\r\nblank lines\r\n"), (151, "http://bad url\r\nX: y", "x" * 200_000), (None, "http://null.org/", "same page")]


def test_warc_round_trip_and_rolling(spark):
    rows = pages()
    folder = working_path(spark, "warc-test")
    manifest = warc.write_warc(spark.createDataFrame(rows, PAGES).withColumns({"digest": F.lit("clash"), "latest": F.lit(1)}).repartition(3), folder, roll=2000).collect()
    assert sum(m["records"] for m in manifest) == len(rows) and len(manifest) > 10
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[h or ""] = max(largest.get(h or "", i), i)
    seen = 0
    for r in warc.read_warc(spark, folder).collect():
        html = next(h for i, _, h in rows if i == r["page_id"]) or ""
        body, top = html.encode(), largest[html]
        is_top = r["page_id"] == top
        assert (r["payload_bytes"], r["payload_digest"], r["digest_ok"]) == (len(body), warc.base32_sha1(body), True)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if is_top else ("revisit", top))
        assert r["payload"] == (body if is_top else None)
        seen += 1
    assert seen == len(rows)


def test_warc_is_deterministic_and_guarded(spark):
    df = spark.createDataFrame(pages(), PAGES).repartition(3, "page_id")
    first, second = (working_path(spark, "warc-test") for _ in range(2))
    lists = [sorted(tuple(r) for r in warc.write_warc(df, f, roll=5000).collect()) for f in (first, second)]
    assert lists[0] == lists[1]
    local = first.removeprefix("file:").replace("///", "/")
    name = lists[0][0][0]
    with gzip.open(f"{local}/{name}") as f:  # any gzip reader reads it
        assert f.read().startswith(b"WARC/1.1\r\nWARC-Type: re")
    with open(f"{local}/{name}", "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="not the file that the manifest names"):
        warc.read_warc(spark, first).count()
    assert warc.write_warc(spark.createDataFrame([], PAGES), working_path(spark, "warc-test")).count() == 0


def brute_url(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = host.translate(brute.LOWER)
    fits = [(r, v) for r, v in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return (host, path, *max(fits, key=lambda x: len(x[0]), default=(None, None)))


def test_urls_equal_brute_force(spark):
    given = [
        None, "", "no scheme.net/", "http://", "http://NET/", "https://a.Example.NET/en/x?y#z", "https://example.net/en", "http://example.com/de/1", "http://fr.org/fr/", "http://xorg/fr/",
        "http://a.org?x=/fr/", "http://a.org#/fr/", "ftp://b.net", "http://b.net/", "x://y://z.net/", "http://É.net/Ü?q", "http://a.net/\nb?c", "http://" + "a" * 30_000 + ".net/" + "b" * 30_000,
    ]
    given += [f"http://h{i}.example.{t}/{p}/{i}" for i in range(30) for t, p in (("net", "en"), ("net", "xx"), ("com", "de"), ("org", "fr"), ("com", "zz"))]
    rows = [(i, u, "clash", "clash") for i, u in enumerate([*given, *given[:20]])]
    df = spark.createDataFrame(rows, "page_id bigint, url string, host string, __n string")
    out = urls.filter_urls(df, "url", URL_RULES)
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = brute_url(r["url"], URL_RULES)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)
    assert len({(r["url"], r["verdict"]) for r in got}) == len(set(given))
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert urls.filter_urls(spark.createDataFrame([], "page_id bigint, url string"), "url", URL_RULES).count() == 0


def test_trees_learn_from_labels(spark):
    rng = random.Random(3)
    spam = [f"http://cheap-{rng.randrange(10**6)}-pills-{i}.example{i % 9}.biz/buy/{rng.randrange(10**9)}?a=1&b=2&c={i}" for i in range(300)]
    good = [f"https://www.site{i % 50}.org/articles/{rng.choice(['science', 'news', 'art'])}" for i in range(300)]
    labelled = [(u, 1) for u in spam[:200]] + [(u, 0) for u in good[:200]]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(spam[200:] + good[200:])], "page_id bigint, url string")
    got = urls.filter_urls(df, "url", [], spark.createDataFrame(labelled, "url string, label int")).collect()
    right = sum((r["verdict"] == "block") == (r["page_id"] < 100) for r in got)
    assert right >= 0.95 * len(got)


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline
    from provenor.llm import fertility
    from provenor.llm.queries import PIECE_MODEL

    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "SentencePiece encoding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(1).select(F.lit(10**6).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", F.lit(None).cast("bigint").alias("n_chars"))
    docs = docs.unionByName(extra)
    columns = docs.columns

    judged = stages["quality rules"](spark, docs, SF).cache()
    kept = {r["doc_id"]: r["text"] for r in judged.collect()}
    verdict = {r["doc_id"]: r["kept"] for r in fertility.quality_rules(docs, fertility.model_bytes(spark, PIECE_MODEL)).collect()}
    assert judged.columns == columns and set(kept) == {i for i, k in verdict.items() if k}
    assert not any(brute.quality(t)[5] for t in kept.values())

    apart = stages["n-gram Jaccard join"](spark, judged, SF).cache()
    want = {i for i, _, c in brute.near_duplicates(sorted(kept.items())) if i == c}
    assert apart.columns == columns and sorted(r["doc_id"] for r in apart.collect()) == sorted(want)

    cut = stages["substring dedup"](spark, apart, SF).cache()
    expected = {i: (t if gone else kept[i]) for i, n, gone, t in brute.remove_repeats([(i, kept[i]) for i in sorted(want)]) if gone < n}
    assert cut.columns == columns and {r["doc_id"]: r["text"] for r in cut.collect()} == expected

    clean = stages["benchmark decontamination"](spark, cut, SF).cache()
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    inside = {i for i, t in expected.items() if any(f" {' '.join(brute.words(b['text'], True))} " in f" {' '.join(brute.words(t, True))} " for b in items)}
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} == set(expected) - inside

    last = stages["SentencePiece encoding"](spark, clean, SF)
    assert sorted(r["doc_id"] for r in last.collect()) == sorted(set(expected) - inside)


def test_suffix_statistics_are_not_shared(spark):
    hosts = spark.range(0, 100_000, 1, 4).select(F.concat(F.lit("https://a.d"), "id", F.lit(".net/p")).alias("url"), F.lit(1.0).alias("__label"))
    labelled = urls.lexical(urls.prepared(hosts.select(F.col("url").alias("u"), "__label"), "u", []))
    statistics = urls.suffix_statistics(labelled)
    assert statistics.count() == 100_000 and statistics.agg(F.max("__n")).first()[0] == 1
    asked = spark.createDataFrame([(f"http://x.unknown{i}.net/",) for i in range(200)] + [("http://x.d7.net/",)] * 3, "u string")
    got = urls.with_suffix(urls.lexical(urls.prepared(asked, "u", [])), statistics).select("u", "suffix_block_rate", "suffix_log_count").collect()
    assert len(got) == 203
    for r in got:
        assert (r[1], r[2]) == ((2 / 3, pytest.approx(math.log(2))) if "d7" in r["u"] else (0.5, 0.0))


def test_pipeline_stages_take_empty_tables(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
