"""URL filter: longest-match rules, and gradient-boosted trees on lexical features for the rest.

Everything is DataFrame expressions and Spark ML; no Python runs on executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenor.session import materialise

FEATURES = [
    "url_length", "host_length", "path_length", "path_depth", "host_labels", "digit_ratio", "host_digit_ratio", "hyphens", "host_hyphens",
    "n_params", "has_fragment", "is_https", "path_entropy", "host_entropy", "suffix_block_rate", "suffix_log_count", "vowel_ratio",
]


#: A suffix (last two host labels) is spread over so many shares of its rows where it is joined.
SALTS = 16


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, other letters as they are."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null url or one without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^[^?#]*", 0)
    return lower_ascii(host), path


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule ``(host/path prefix, verdict)`` that fits, and its verdict; null without one."""
    ordered = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, says in reversed(ordered):
        at, prefix = name.split("/", 1)
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit("/" + prefix))
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def entropy(c: Column) -> Column:
    """Bits per character of the distribution of characters."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    n = F.size(chars)
    parts = F.transform(F.array_distinct(chars), lambda x: (F.length(c) - F.length(F.replace(c, x))) / n)
    return F.when(n > 0, F.aggregate(parts, F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(F.lit(0.0))


def _count(c: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(c, f"[^{kept}]", "")).cast("double")


def lexical(df: DataFrame) -> DataFrame:
    """Adds the features of the url itself; needs ``__url``, ``__host`` and ``__path``."""
    url, host, path = F.coalesce("__url", F.lit("")), F.col("__host"), F.col("__path")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    share = lambda n, c: n / F.greatest(F.length(c), F.lit(1))
    return df.withColumns({
        "url_length": F.length(url).cast("double"), "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"),
        "path_depth": _count(path, "/"), "host_labels": _count(host, ".") + 1, "digit_ratio": share(_count(url, "0-9"), url),
        "host_digit_ratio": share(_count(host, "0-9"), host), "hyphens": _count(path, "-"), "host_hyphens": _count(host, "-"),
        "n_params": F.when(query == "", 0.0).otherwise(_count(query, "&") + 1), "has_fragment": url.contains("#").cast("double"),
        "is_https": F.startswith(url, F.lit("https://")).cast("double"), "path_entropy": entropy(path), "host_entropy": entropy(host),
        "vowel_ratio": share(_count(host, "aeiou"), host), "__suffix": F.substring_index(host, ".", -2),
    })


def prepared(df: DataFrame, url: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """The columns of ``df`` with ``__url``, host, path, rule and the rule's verdict, all prefixed by ``__``."""
    parts = df.withColumn("__url", df[url].cast("string"))
    host, path = host_path(F.col("__url"))
    parts = parts.withColumns({"__host": host, "__path": path})
    rule, verdict = longest_rule(F.col("__host"), F.col("__path"), rules)
    return parts.withColumns({"__rule": rule, "__verdict": verdict})


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """Per suffix, over all labelled urls: how many, and how many are blocked."""
    return labelled.groupBy("__suffix").agg(F.count(F.lit(1)).cast("double").alias("__n"), F.sum("__label").cast("double").alias("__blocked"))


def with_suffix(df: DataFrame, statistics: DataFrame, own: Column | None = None) -> DataFrame:
    """Smoothed share of blocked urls of the suffix; ``own`` (0/1) is the row's label, left out of its own statistics.

    Rows of one suffix are salted by a hash of the row, so that no task gets all of a frequent one.
    """
    salted = statistics.withColumn("__salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    row = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    joined = df.withColumn("__salt", F.pmod(F.xxhash64(*row), F.lit(SALTS)).cast("int")).join(salted, ["__suffix", "__salt"], "left").drop("__salt")
    n, blocked = F.coalesce("__n", F.lit(0.0)), F.coalesce("__blocked", F.lit(0.0))
    if own is not None:
        n, blocked = n - 1, blocked - own
    return joined.withColumns({"suffix_block_rate": (blocked + 1) / (n + 2), "suffix_log_count": F.log1p(n)})


def fit_trees(labelled: DataFrame, statistics: DataFrame, sample: int = 20_000, trees: int = 10, depth: int = 4) -> GBTClassificationModel | float:
    """Boosted trees from at most ``sample`` labelled urls (those with the smallest hashes of their text), stored once.

    A hash threshold leaves between ``sample`` and about twice as many rows before they are sorted.

    With one label only there is nothing to learn; the share of blocked urls (0 without any) is returned.
    """
    every = max(1, labelled.count() // max(sample, 1))
    near = labelled.where(F.pmod(F.xxhash64("__url", F.lit(5)), F.lit(every)) == 0)
    sampled = near.orderBy(F.xxhash64("__url", F.lit(7)), "__url").limit(sample)
    rows = materialise(with_suffix(sampled, statistics, F.col("__label")).select(*FEATURES, "__label"), "labelled")
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("__label").alias("blocked")).first()
    if not counts["n"] or counts["blocked"] in (0, counts["n"]):
        return float(bool(counts["n"] and counts["blocked"]))
    train = VectorAssembler(inputCols=FEATURES, outputCol="__features").transform(rows)
    return GBTClassifier(featuresCol="__features", labelCol="__label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=11, cacheNodeIds=False).fit(train)


def filter_urls(df: DataFrame, url: str, rules: Sequence[tuple[str, str]], labels: DataFrame | None = None, sample: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """Each row of ``df`` with ``host``, ``path``, ``rule``, ``verdict`` and ``block_score``.

    The rule's verdict stands where a rule fits; elsewhere boosted trees decide,
    trained on ``labels`` (columns url and label 0/1), or, without them, on the
    urls that the rules decide. Columns of ``df`` with the names of results give
    way to them. A null url, or one without ``://``, has an empty host and path
    and is judged by its features; repeated urls are judged alike; an empty
    table gives an empty one and trains nothing. The sample bounds training
    only: suffix statistics come from all labelled urls.
    """
    results = {"host", "path", "rule", "verdict", "block_score"}
    keep = [c for c in df.columns if c not in results]
    base = lexical(prepared(df.select(*(F.col(c).alias(f"__in_{c}") for c in keep), df[url].alias("__source")), "__source", rules))
    if labels is None:
        labelled = base.where("__verdict is not null").withColumn("__label", (F.col("__verdict") == "block").cast("double"))
    else:
        labelled = lexical(prepared(labels.select(F.col("url").alias("__source"), F.col("label").cast("double").alias("__label")), "__source", rules))
    statistics = suffix_statistics(labelled)
    model = fit_trees(labelled, statistics, sample)
    judged = with_suffix(base, statistics)
    if isinstance(model, float):
        scored = judged.withColumn("block_score", F.lit(model))
    else:
        assembled = VectorAssembler(inputCols=FEATURES, outputCol="__features").transform(judged)
        scored = model.transform(assembled).withColumn("block_score", vector_to_array("probability")[1])
    says = F.coalesce("__verdict", F.when(F.col("block_score") > threshold, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select(
        *(F.col(f"__in_{c}").alias(c) for c in keep), F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), says.alias("verdict"), "block_score"
    )
