"""Joins: enrichment, reconciliation, keep-lists and lookups.

Joins carry no broadcast hints: adaptive execution broadcasts a side once its
measured size is below the threshold and otherwise splits skewed partitions.
``salts`` spreads a key that is known to be hot when a plan leaves adaptive
execution no room to split it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenor import constants as K
from provenor.functions import norm_key, not_blank
from provenor.operators.sorting import n_per_group
from provenor.session import materialise


def keyed_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", salts: int = 0, parts: int = 0) -> DataFrame:
    """Equi-join; with ``salts`` every key of ``left`` is spread over that many buckets.

    The salt is a hash of the left row, so a repeated task yields the same rows.
    The right side is crossed with the salts and not exploded: Spark sizes an
    exploded table like the table itself, and would broadcast all its copies.
    ``parts`` deals the left rows over that many tasks by key and salt; without
    it the session's shuffle partitions decide.
    """
    on = list(on)
    if not salts:
        return (left.repartition(parts, *on) if parts else left).join(right, on, how)
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted join cannot be {how}")
    hashed = [F.col(f"`{f.name}`") for f in left.schema if "map<" not in f.dataType.simpleString()]
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(*hashed), F.lit(salts)))
    copies = right.crossJoin(F.broadcast(right.sparkSession.range(0, salts, 1, 1).withColumnRenamed("id", "__salt")))
    dealt = salted.repartition(parts, *on, "__salt") if parts else salted
    return dealt.join(copies, [*on, "__salt"], how).drop("__salt")


def with_stats(df: DataFrame, stats: DataFrame, name: str = "__stats") -> DataFrame:
    """Every row with a one-row DataFrame as struct column ``name``.

    A scalar subquery is computed once and inlined as a value: it needs neither a
    join nor a round trip through the driver.
    """
    one = stats.select(F.struct(*[F.col(c) for c in stats.columns]).alias("stats"))
    return df.withColumn(name, one.scalar())


def with_global_stats(df: DataFrame, aggregates: Mapping[str, Column], of: DataFrame | None = None) -> DataFrame:
    """Every row plus aggregates over the whole of ``of`` (default: ``df`` itself)."""
    stats = (of if of is not None else df).agg(*[c.alias(n) for n, c in aggregates.items()])
    return with_stats(df, stats).select(*[F.col(f"`{c}`") for c in df.columns], "__stats.*")


def enrich_left(
    df: DataFrame, dim: DataFrame, keys: Sequence[str], prefer: Mapping[str, Sequence[str]], salts: int = 0
) -> DataFrame:
    """Left join; each ``prefer`` column becomes the first non-null of the listed ones."""
    joined = keyed_join(df, dim, keys, "left", salts)
    filled = joined.withColumns({out: F.coalesce(*[F.col(c) for c in cols]) for out, cols in prefer.items()})
    used = {c for out, cols in prefer.items() for c in cols if c != out and c not in df.columns}
    return filled.drop(*used)


def reconcile(left: DataFrame, right: DataFrame, key: str, flag: str) -> DataFrame:
    """Full outer join on a non-blank key with a flag for presence on the right."""
    marked = right.withColumn(flag, F.lit(True))
    joined = left.join(marked, key, "full_outer")
    return joined.withColumn(flag, F.coalesce(F.col(flag), F.lit(False))).where(not_blank(F.col(key).cast("string")))


def attach_dim(fact: DataFrame, dim: DataFrame, key: Sequence[str], salts: int = 0) -> DataFrame:
    """Fact rows with the columns of their dimension row; rows without one are kept."""
    return keyed_join(fact, dim, key, "left", salts)


def keep_members(df: DataFrame, members: DataFrame, keys: Sequence[str], salts: int = 0) -> DataFrame:
    """Rows whose key occurs in ``members``."""
    return keyed_join(df, members.select(*keys).distinct(), keys, "left_semi", salts)


def missing(df: DataFrame, ref: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key does not occur in ``ref``."""
    return df.join(ref.select(*keys).distinct(), list(keys), "left_anti")


def map_entities(
    left: DataFrame, names: DataFrame, left_key: str, right_keys: Sequence[str], salts: int = 0
) -> DataFrame:
    """Inner join on a normalised name; one left row may meet several right rows.

    The right name is the first non-blank of ``right_keys``. Both sides and the
    result are made distinct, so repeated rows never multiply.
    """
    first = F.coalesce(*[F.when(not_blank(k), F.col(k)) for k in right_keys])
    a = left.withColumn("__name", norm_key(left_key)).where(not_blank("__name")).distinct()
    b = names.withColumn("__name", norm_key(first)).where(not_blank("__name")).drop(*right_keys).distinct()
    return keyed_join(a, b, ["__name"], "inner", salts).drop("__name").distinct()


def attach_ends(
    edges: DataFrame, dim: DataFrame, key: str, src: str, dst: str, salts: int = 0, how: str = "left", parts: int = 0
) -> DataFrame:
    """Columns of ``dim`` at both ends of every edge, named ``*_src`` and ``*_dst``; ``dim`` is unique on its key."""
    def end(col: str, suffix: str) -> DataFrame:
        return dim.select(
            F.col(key).alias(col), *[F.col(c).alias(f"{c}_{suffix}") for c in dim.columns if c != key]
        )

    one = keyed_join(edges, end(src, "src"), [src], how, salts, parts)
    return keyed_join(one, end(dst, "dst"), [dst], how, salts, parts)


def assemble(base: DataFrame, key: str, features: Sequence[DataFrame], defaults: Mapping[str, object]) -> DataFrame:
    """Chain of left joins on one key, with defaults for absent features.

    Each feature table must be unique on ``key``, so the row count stays.
    """
    out = base
    for f in features:
        out = out.join(f, key, "left")
    types = dict(out.dtypes)
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(types[c])) for c, v in defaults.items()})


def attach_one(df: DataFrame, dim: DataFrame, key: str, value: str) -> DataFrame:
    """Left join of one value per key, the smallest where the dimension repeats a key."""
    return df.join(dim.groupBy(key).agg(F.min(value).alias(value)), key, "left")


def attach_label(df: DataFrame, labels: Mapping[object, str], key: str, out: str, default: Column | None = None) -> DataFrame:
    """Label of a small literal mapping; ``default`` is used for other keys."""
    pick = None
    for k, v in labels.items():
        hit = F.col(key) == F.lit(k)
        pick = F.when(hit, v) if pick is None else pick.when(hit, v)
    if pick is None:
        return df.withColumn(out, default if default is not None else F.lit(None).cast("string"))
    return df.withColumn(out, pick if default is None else pick.otherwise(default))


def header_members(wide: DataFrame, meta: DataFrame, key_cols: Sequence[str], meta_id: str, out: str = "sample_id") -> DataFrame:
    """Column names of a wide matrix that occur, normalised, in a metadata column."""
    names = [(c.strip().upper(),) for c in wide.columns if c not in key_cols]
    header = wide.sparkSession.createDataFrame(names, f"{out} string").distinct()
    trimmed = F.regexp_replace(F.col(meta_id).cast("string"), r"^\s+|\s+$", "")
    return keep_members(header, meta.select(norm_key(trimmed).alias(out)), [out])


def highlight(points: DataFrame, ranks: DataFrame, key: str, rank: str, n: int, out: str) -> DataFrame:
    """Best rank per normalised key, and whether it is within the first ``n``."""
    best = (
        ranks.where(F.col(rank).isNotNull())
        .groupBy(norm_key(key).alias("__name")).agg(F.min(rank).alias(rank))
    )
    joined = points.withColumn("__name", norm_key(key)).join(best, "__name", "left").drop("__name")
    return joined.withColumn(out, F.coalesce(F.col(rank) <= n, F.lit(False)))


def backfill(df: DataFrame, ref: DataFrame, key: str, value: str, reason: str, text: str = K.UNMATCHED_REASON) -> DataFrame:
    """Missing ``value`` taken from ``ref`` by normalised key; missing ``reason`` set to a text."""
    found = (
        ref.where(F.col(value).isNotNull())
        .groupBy(norm_key(key).alias("__name")).agg(F.min(value).alias("__found"))
    )
    joined = df.withColumn("__name", norm_key(key)).join(found, "__name", "left")
    stated = F.col(reason) if reason in df.columns else F.lit(None).cast("string")
    return joined.withColumns({
        value: F.coalesce(F.col(value), F.col("__found")),
        reason: F.coalesce(stated, F.lit(text)),
    }).drop("__name", "__found")


_RUN = r"[A-Z0-9_.\-]+"


def entity_mentions(
    docs: DataFrame,
    doc_id: str,
    text: str,
    entries: DataFrame,
    names: Sequence[str],
    entry_key: str,
    entry_order: Sequence[Column],
    limit: int = K.MENTION_LIMIT,
    min_length: int = K.MENTION_MIN_LENGTH,
    loose_prefix: str | None = K.LOOSE_ID_PREFIX,
) -> DataFrame:
    """Dictionary entries named in each document, the first ``limit`` per document.

    A name counts where no identifier character (letter, digit, ``_ . -``) touches
    it. Documents and names meet in one equi-join on anchors: whole runs of
    identifier characters, or three characters for names without any. Only names
    with other characters inside are checked once more against the text. Names
    that start with ``loose_prefix`` also count inside a longer run.

    The texts are scanned once: which kinds of names the dictionary holds is
    looked up first, and the matches are stored before they are verified.
    """
    # runs are their own anchors; the marks of the other kinds cannot occur in a run
    gram, loose = F.lit("~"), F.lit("<")
    names_of = entries.select(
        F.col(entry_key).cast("string").alias("__entry"),
        F.explode(F.array(*[norm_key(n) for n in names])).alias("__name"),
    ).where(F.length("__name") >= min_length).distinct()
    runs = F.regexp_extract_all("__name", F.lit(_RUN), F.lit(0))
    longest = F.array_max(F.transform("__runs", lambda r: F.struct(F.length(r).alias("n"), r.alias("run")))).getField("run")
    is_run = F.coalesce(F.try_element_at("__runs", F.lit(1)) == F.col("__name"), F.lit(False))
    ways = [
        F.struct(
            F.when(is_run, F.col("__name")).when(F.size("__runs") > 0, longest)
            .otherwise(F.concat(gram, F.left("__name", F.lit(3)))).alias("__anchor"),
            F.when(~is_run, F.col("__name")).alias("__check"),
        )
    ]
    if loose_prefix:
        inner = is_run & F.col("__name").startswith(loose_prefix.upper())
        ways.append(F.struct(F.when(inner, F.concat(loose, "__name")).alias("__anchor"), F.lit(None).cast("string").alias("__check")))
    dictionary = names_of.withColumn("__runs", runs).select("__entry", F.inline(F.array(*ways))).where(F.col("__anchor").isNotNull())

    def holds(mark: Column) -> Column:
        return F.coalesce(F.bool_or(F.startswith("__anchor", mark)), F.lit(False))

    loose_length = F.max(F.when(F.startswith("__anchor", loose), F.length("__anchor") - 1))
    has_signs, longest_loose = dictionary.agg(holds(gram), loose_length).first()
    upper = docs.select(F.col(doc_id), F.upper(text).alias("__text"))
    stretches = F.regexp_extract_all("__text", F.lit(r"[^A-Z0-9_.\-]{3,}"), F.lit(0))
    found = [F.regexp_extract_all("__text", F.lit(_RUN), F.lit(0))]
    if has_signs:
        found.append(F.flatten(F.transform(stretches, lambda s: F.transform(
            F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.concat(gram, F.substring(s, i, F.lit(3)))
        ))))
    if longest_loose is not None:
        mark = loose_prefix.upper().replace(".", r"\.")
        tails = F.regexp_extract_all("__text", F.lit(f"(?=({mark}{_RUN[:-1]}{{0,{longest_loose - len(loose_prefix)}}}))"), F.lit(1))
        found.append(F.flatten(F.transform(tails, lambda t: F.transform(
            F.sequence(F.lit(len(loose_prefix)), F.least(F.length(t), F.lit(longest_loose))), lambda n: F.concat(loose, F.left(t, n))
        ))))
    anchors = upper.select(doc_id, F.explode(F.array_distinct(F.concat(*found))).alias("__anchor"))
    met = materialise(anchors.join(dictionary, "__anchor").select(doc_id, "__entry", "__check").distinct(), "mentions")
    bounded = F.concat(
        F.lit(r"(?<![A-Z0-9_.\-])\Q"), F.replace(F.col("__check"), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![A-Z0-9_.\-])")
    )
    checked = (
        met.where(F.col("__check").isNotNull()).join(upper, doc_id)
        .where(F.contains("__text", F.col("__check")) & F.rlike(F.col("__text"), bounded))
    )
    hits = met.where(F.col("__check").isNull()).select(doc_id, "__entry").unionByName(checked.select(doc_id, "__entry"))

    named = hits.distinct().join(entries.withColumn("__entry", F.col(entry_key).cast("string")), "__entry").drop("__entry")
    return n_per_group(named, [doc_id], [*entry_order, F.col(entry_key)], limit, number="mention_no")
