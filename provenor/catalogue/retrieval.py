"""Checked queries for sections, nearest passages and context."""

from pyspark.sql import functions as F

from provenor.catalogue.base import big, query, r6, tab, with_views, x_diff, x_edges, x_targets
from provenor.functions import embedding_text, question_text, similarity
from provenor.operators import retrieval

# pages split at their heading tags; a section id is the tag, the title what the heading holds
_PAGE_SECTIONS = dict(
    split=r"(?=<h[1-6]>)", starts="^<h[1-6]>", title=r"^<(h[1-6])>(.*?)</h[1-6]>.*$", chunk_id=r'href="([^"]+)"',
    attrs={"first_bold": r"<b>([^<]*)</b>"},
)

_SECTION_SQL = """
WITH r AS (SELECT page_id, unnest(string_split(regexp_replace(html, '<(h[1-6])>', chr(1) || '<\\1>', 'g'), chr(1))) AS part,
                  unnest(range(len(string_split(regexp_replace(html, '<(h[1-6])>', chr(1) || '<\\1>', 'g'), chr(1))))) AS section_no FROM pages),
t AS (SELECT page_id, section_no, regexp_replace(part, '^\\s+|\\s+$', '', 'g') AS text FROM r),
h AS (SELECT *, rtrim(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))[1], ' ') AS head FROM t),
chunks AS (SELECT page_id, CAST(section_no AS INTEGER) AS section_no, coalesce(nullif(regexp_extract(text, 'href="([^"]+)"', 1), ''), lower(regexp_extract(head, '^<(h[1-6])>(.*?)</h[1-6]>.*$', 1))) AS chunk_id,
                  regexp_extract(head, '^<(h[1-6])>(.*?)</h[1-6]>.*$', 1) AS section_id, regexp_extract(head, '^<(h[1-6])>(.*?)</h[1-6]>.*$', 2) AS title,
                  regexp_extract(text, '<b>([^<]*)</b>', 1) AS first_bold, text
           FROM h WHERE regexp_matches(text, '^<h[1-6]>') AND regexp_matches(head, '^<(h[1-6])>(.*?)</h[1-6]>.*$'))
"""


def page_chunks(spark, sf):
    return retrieval.chunk_sections(tab(spark, sf, "pages").select("page_id", "html"), ["page_id"], "html", **_PAGE_SECTIONS)


@query("ret_chunk_sections", _SECTION_SQL + "SELECT page_id, section_no, chunk_id, section_id, title, first_bold, length(text) AS n_chars FROM chunks")
def ret_chunk_sections(spark, sf):
    return page_chunks(spark, sf).withColumn("n_chars", big(F.length("text"))).drop("text")


@query("ret_duplicate_chunks", _SECTION_SQL + "SELECT chunk_id, count(*) AS n FROM chunks GROUP BY 1 HAVING count(*) > 1")
def ret_duplicate_chunks(spark, sf):
    return retrieval.duplicate_chunks(page_chunks(spark, sf), ["chunk_id"])


@query("ret_embedding_text", "SELECT doc_id, md5('title: ' || source || ' ' || lang || ' | text: ' || text) AS digest FROM documents")
def ret_embedding_text(spark, sf):
    docs = tab(spark, sf, "documents")
    return docs.select("doc_id", F.md5(embedding_text(F.concat_ws(" ", "source", "lang"), "text")).alias("digest"))


def label_centres(spark, sf):
    """One question vector per label: the mean of its vectors."""
    cells = tab(spark, sf, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))
    means = cells.groupBy("label", "i").agg(F.avg("v").alias("m"))
    # a vector has a fixed number of elements, so the list is short
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"])
    return means.groupBy(F.col("label").cast("bigint").alias("question_id")).agg(ordered.alias("vec"))


_TOPK_SQL = """
WITH c AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1, 2),
q AS (SELECT CAST(label AS BIGINT) AS question_id, list(m ORDER BY i) AS vec FROM c GROUP BY 1),
d AS (SELECT question_id, vec_id, 1 - list_cosine_similarity(q.vec, CAST(e.embedding AS DOUBLE[])) AS distance FROM q, embeddings e),
k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, vec_id) AS place FROM d QUALIFY place <= 6)
"""


def nearest(spark, sf, **sizes):
    return retrieval.cosine_topk(label_centres(spark, sf), tab(spark, sf, "embeddings"), "question_id", "vec", "vec_id", "embedding", **sizes)


@query("ret_cosine_topk", _TOPK_SQL + "SELECT question_id AS question, vec_id AS passage, CAST(place AS INTEGER) AS place, round(distance, 6) AS distance FROM k")
def ret_cosine_topk(spark, sf):
    return nearest(spark, sf).select("question", "passage", "place", r6("distance").alias("distance"))


@query("ret_cosine_blocks", _TOPK_SQL + "SELECT question_id AS question, vec_id AS passage, CAST(place AS INTEGER) AS place, round(distance, 6) AS distance FROM k")
def ret_cosine_blocks(spark, sf):
    """The same with several blocks of questions."""
    return nearest(spark, sf, question_block=4).select("question", "passage", "place", r6("distance").alias("distance"))


@query("ret_similarity", """
SELECT event_id, round(greatest(0.0e0, least(1.0e0, 1 - (value - 20) / 50)), 6) AS similarity FROM events""")
def ret_similarity(spark, sf):
    return tab(spark, sf, "events").select("event_id", r6(similarity((F.col("value") - 20) / 50)).alias("similarity"))


@query("ret_citations", _TOPK_SQL + "SELECT question_id AS question, vec_id AS passage, round(greatest(0.0e0, least(1.0e0, 1 - distance)), 4) AS similarity FROM k")
def ret_citations(spark, sf):
    return retrieval.citations(nearest(spark, sf), ["question", "passage"], "distance")


@query("ret_context", """
WITH p AS (SELECT source, lang, doc_id, n_chars, '[' || lang || ']' || chr(10) || text AS part FROM documents),
r AS (SELECT *, row_number() OVER w AS place, sum(length(part)) OVER w AS used FROM p WINDOW w AS (PARTITION BY source, lang ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING)),
o AS (SELECT source, lang, min(place) AS stop FROM r WHERE used > 3000 AND place > 1 GROUP BY 1, 2),
k AS (SELECT r.* FROM r LEFT JOIN o USING (source, lang) WHERE stop IS NULL OR place < stop)
SELECT source, lang, md5(string_agg(part, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place)) AS digest, count(*) AS n_passages, CAST(max(used) AS BIGINT) AS n_chars FROM k GROUP BY 1, 2""")
def ret_context(spark, sf):
    docs = tab(spark, sf, "documents").withColumn("label", F.col("lang"))
    c = retrieval.assemble_context(docs, ["source", "lang"], [F.col("n_chars"), F.col("doc_id")], "label", "text", "doc_id", budget=3000)
    return c.select("source", "lang", F.md5("context").alias("digest"), "n_passages", big("n_chars").alias("n_chars"))


@query("ret_bundle", with_views("x_diff", "x_edges", "x_targets", body="""
, t AS (SELECT 'top_targets' AS part, rank AS place, gene_name AS name, round(final_score, 6) AS value FROM x_targets QUALIFY row_number() OVER (ORDER BY rank) <= 100),
e AS (SELECT 'top_effects' AS part, row_number() OVER (ORDER BY round(abs(effect), 6) DESC, gene) AS place, gene AS name, round(effect, 6) AS value FROM x_diff QUALIFY place <= 20),
g AS (SELECT 'edge_examples' AS part, row_number() OVER (ORDER BY score DESC, src, dst) AS place, src || '-' || dst AS name, CAST(score AS DOUBLE) AS value FROM x_edges QUALIFY place <= 5),
d AS (SELECT 'directions' AS part, row_number() OVER (ORDER BY direction) AS place, direction AS name, CAST(count(*) AS DOUBLE) AS value FROM x_diff GROUP BY direction)
SELECT part, CAST(place AS BIGINT) AS place, name, value FROM t UNION ALL SELECT part, place, name, value FROM e UNION ALL SELECT part, place, name, value FROM g UNION ALL SELECT part, place, name, value FROM d
UNION ALL SELECT 'edge_count', 1, 'edge_count', CAST(count(*) AS DOUBLE) FROM x_edges"""))
def ret_bundle(spark, sf):
    """The JSON record, read back as rows."""
    diff = x_diff(spark, sf).select("gene", r6("effect").alias("effect"), "direction")
    bundle = retrieval.context_bundle({
        "top_targets": (x_targets(spark, sf).select("rank", F.col("gene_name").alias("name"), r6("final_score").alias("value")), [F.col("rank")], 100),
        "top_effects": (diff.select(F.col("gene").alias("name"), F.col("effect").alias("value"), F.abs("effect").alias("size")), [F.col("size").desc(), F.col("name")], 20),
        "edge_examples": (
            x_edges(spark, sf).select(F.concat_ws("-", "src", "dst").alias("name"), F.col("score").cast("double").alias("value"), "src", "dst"), [F.col("value").desc(), F.col("src"), F.col("dst")], 5,
        ),
        "directions": (diff.groupBy(F.col("direction").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value")), [F.col("name")], None),
    }, {"edge_count": x_edges(spark, sf)})
    item = "array<struct<name: string, value: double>>"
    lists = ("top_targets", "top_effects", "edge_examples", "directions")
    read = bundle.select(F.from_json("bundle", ", ".join(f"{n} {item}" for n in lists) + ", edge_count bigint").alias("b"))
    parts = [read.select(F.lit(n).alias("part"), F.posexplode(f"b.{n}").alias("place", "row")).select("part", (F.col("place") + 1).cast("bigint").alias("place"), "row.name", "row.value") for n in lists]
    out = read.select(F.lit("edge_count").alias("part"), F.lit(1).cast("bigint").alias("place"), F.lit("edge_count").alias("name"), F.col("b.edge_count").cast("double").alias("value"))
    for part in parts:
        out = out.unionByName(part)
    return out


@query("ret_question_text", "SELECT event_id, 'task: question answering | query: ' || event_type || ' ' || user_id AS text FROM events")
def ret_question_text(spark, sf):
    return tab(spark, sf, "events").select("event_id", question_text(F.concat_ws(" ", "event_type", "user_id")).alias("text"))
