"""Licence scan: a trained paragraph classifier, confirmed by templates.

Notices are sought in lines, in each two consecutive lines and in paragraphs
(lines up to a blank one), so that wrapped ones are found; what is long is read
in overlapping windows. Hashed word
unigrams and bigrams feed a multinomial logistic regression (Spark ML) with one
class per licence family and one for unknown text. Its probabilities are
calibrated by a temperature found on held-out examples, and a prediction only
counts if the paragraph also contains enough of a template of that family.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenor.llm.packing import record_batch, spark_schema
from provenor.llm.words import U, Words, mix, run_hash, slices

FEATURES = 1 << 15
LINE_WORDS = 40
UNKNOWN = "unknown"
MIN_PROBABILITY = 0.5
MIN_TEMPLATE = 0.6
NEGATIVES = 4000
PER_TEMPLATE = 40

#: Usual notices of each licence family.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "BSD": [
        "Distributed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "public domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal",
    ],
    "proprietary": [
        "Copyright. All rights reserved.",
        "No part of this publication may be reproduced, distributed or transmitted in any form without prior written permission of the publisher",
    ],
}

FOUND = pa.schema([
    ("doc_id", pa.int64()), ("family", pa.string()), ("n_paragraphs", pa.int64()), ("probability", pa.float64()), ("template", pa.float64()), ("first_word", pa.int64()),
])


def pair_hash(words: np.ndarray) -> np.ndarray:
    """Hashes of adjacent word pairs."""
    return run_hash(words, 2)


def columns(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the words and of the pairs."""
    return (words & U(FEATURES - 1)).astype(np.int64), (mix(pair_hash(words)) & U(FEATURES - 1)).astype(np.int64)


def vector(words: np.ndarray) -> SparseVector:
    one, two = columns(words)
    at, times = np.unique(np.concatenate([one, two]), return_counts=True)
    return SparseVector(FEATURES, at.tolist(), (times / np.sqrt(len(one) + len(two))).tolist())


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    words = Words(pa.array(texts, pa.string()), lower=True)
    return [words.hash[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]


def windows(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of words as they are, or as half-overlapping windows where they have more than ``LINE_WORDS`` words."""
    step = LINE_WORDS // 2
    pieces = np.maximum(1, -(-(end - start - LINE_WORDS) // step) + 1)
    place = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = np.repeat(start, pieces) + place * step
    return first, np.minimum(first + LINE_WORDS, np.repeat(end, pieces))


def paragraphs(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the windows of lines, of two consecutive lines and of paragraphs, in the order of their starts."""
    breaks = np.concatenate([[0], np.cumsum(words.data == 10)])
    line = breaks[words.start]
    owner = words.owner()
    if not len(line):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    apart = owner[1:] != owner[:-1]
    start = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | apart]))
    top = np.flatnonzero(np.concatenate([[True], (line[1:] > line[:-1] + 1) | apart]))
    end, bottom = np.append(start[1:], len(line)), np.append(top[1:], len(line))
    follows = np.flatnonzero(~np.isin(start[1:], top))
    many = np.searchsorted(start, bottom) - np.searchsorted(start, top) > 2
    ranges = [(start, end), (start[follows], end[follows + 1]), (top[many], bottom[many])]
    first, last = map(np.concatenate, zip(*(windows(a, b) for a, b in ranges if len(a)), strict=True))
    found = np.unique(first * (len(line) + 1) + last)
    return found // (len(line) + 1), found % (len(line) + 1)


def examples(templates: dict[str, list[str]], noise: list[str], per_template: int, seed: int = 5) -> list[tuple[str, str]]:
    """Notices with words of the corpus around them, and cut short."""
    rng, out = random.Random(seed), []
    some_words = [w for text in noise for w in text.split()] or ["text"]
    for family in sorted(templates):
        for template in templates[family]:
            words = template.split()
            for k in range(per_template):
                before, after = rng.randrange(0, 1 + k % 13), rng.randrange(0, 1 + k % 11)
                kept = words if len(words) < 10 or k % 3 else words[: rng.randrange(len(words) * 2 // 3, len(words) + 1)]
                out.append((" ".join([*rng.choices(some_words, k=before), *kept, *rng.choices(some_words, k=after)]), family))
    return out


class Classifier:
    """Weights per class, their temperature, and the word pairs of the templates."""

    def __init__(self, families: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float, templates: dict[str, list[str]]):
        self.families, self.weights, self.bias, self.temperature = families, weights.T.astype(np.float32), bias, temperature
        self.templates = {f: [np.unique(pair_hash(h)) for h in word_hashes(texts)] for f, texts in templates.items()}

    def probabilities(self, words: Words, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(words.hash)
        one, two = columns(words.hash)
        sums = np.zeros((n + 1, len(self.families)))
        np.cumsum(self.weights[one], axis=0, out=sums[1:])
        pairs = np.zeros((n + 1, len(self.families)))
        np.cumsum(self.weights[two], axis=0, out=pairs[1:n])
        raw = sums[end] - sums[first] + pairs[np.maximum(end - 1, first)] - pairs[first]
        logits = (raw / np.sqrt(2 * (end - first) - 1)[:, None] + self.bias) / self.temperature
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def template(self, family: str, words: np.ndarray) -> float:
        """The largest share of a template's word pairs that the words contain."""
        own = pair_hash(words)
        return max((float(np.isin(t, own).mean()) for t in self.templates[family] if len(t)), default=0.0)


def fit(spark: SparkSession, noise: list[str], templates: dict[str, list[str]] = TEMPLATES, per_template: int = PER_TEMPLATE) -> Classifier:
    """Fits on made-up notices and ``noise`` paragraphs (unknown class); every fifth example is held out for the temperature."""
    rows = examples(templates, noise, per_template) + [(text, UNKNOWN) for text in noise]
    families = sorted({f for _, f in rows} | {UNKNOWN})
    hashed = [(h, families.index(f)) for h, (_, f) in zip(word_hashes([t for t, _ in rows]), rows, strict=True) if len(h)]
    held = [x for i, x in enumerate(hashed) if i % 5 == 0]
    train = spark.createDataFrame([(vector(h), float(y)) for i, (h, y) in enumerate(hashed) if i % 5], ["features", "label"]).repartition(4).cache()
    model = LogisticRegression(maxIter=40, regParam=2e-4, family="multinomial").fit(train)
    train.unpersist()
    weights, bias = np.zeros((len(families), FEATURES)), np.full(len(families), -30.0)
    found = model.coefficientMatrix.toArray()
    weights[: len(found)], bias[: len(found)] = found, model.interceptVector.toArray()
    logits = np.stack([sum(weights[:, c] for x in columns(h) for c in x) / np.sqrt(2 * len(h) - 1) + bias for h, _ in held])
    truth = np.array([y for _, y in held])

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]).mean())

    temperature = min(np.geomspace(0.1, 10, 61), key=loss)
    return Classifier(families, weights, bias, float(temperature), templates)


def noise_paragraphs(docs: DataFrame, most: int) -> list[str]:
    """At most ``most`` paragraphs of the corpus (the middle lines of documents chosen by hash) that no template resembles.

    A hash threshold leaves between ``most`` and twice as many lines of the whole table, before any of them is sent.
    """
    every = max(1, docs.count() // max(most, 1))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(F.trim(x)) > 0)
    picked = docs.where(F.pmod(F.xxhash64(F.lit(11), "id", F.when(F.col("id").isNull(), F.col("text"))), F.lit(every)) == 0).select(F.xxhash64("id").alias("h"), F.substring(F.get(lines, F.floor(F.size(lines) / 2).cast("int")), 1, 400).alias("line")).where("line is not null")
    texts = [r["line"] for r in picked.orderBy("h", "line").limit(most).collect()]
    known = [np.unique(pair_hash(h)) for notices in TEMPLATES.values() for h in word_hashes(notices)]
    return [t for t, h in zip(texts, word_hashes(texts), strict=True) if all(np.isin(k, pair_hash(h)).mean() < 0.3 for k in known if len(k))]


def apart(ranges: list[tuple[int, int]]) -> int:
    """How many ranges there are where those that overlap are one; given in the order of their starts."""
    n, reach = 0, -1
    for start, end in ranges:
        n += start >= reach
        reach = max(reach, end)
    return n


def scan(df: DataFrame, classifier: Classifier, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and licence family found: ``doc_id``, ``family``, ``n_paragraphs``, ``probability``, ``template``, ``first_word``.

    A line, two consecutive lines or a window of a paragraph count when their most
    probable class is a family, with a calibrated probability of a half or more,
    and they have 60 % of the word pairs of one of the family's templates; those
    that overlap count as one in ``n_paragraphs``. ``probability`` and
    ``template`` are the highest found, ``first_word`` the place of the first. Null and empty
    texts have no paragraphs; repeated rows are reported each; other columns are
    not read; an empty table gives no rows. Nothing is shuffled.
    """
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(classifier)

    def run(batches):
        c: Classifier = sent.value
        other = c.families.index(UNKNOWN)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                words = Words(part.column("text"), lower=True)
                first, end = paragraphs(words)
                if not len(first):
                    continue
                p = c.probabilities(words, first, end)
                best = p.argmax(axis=1)
                hits: dict[tuple[int, str], list] = {}
                for k in np.flatnonzero((best != other) & (p.max(axis=1) >= MIN_PROBABILITY)):
                    family = c.families[best[k]]
                    share = c.template(family, words.hash[first[k] : end[k]])
                    if share >= MIN_TEMPLATE:
                        d = int(np.searchsorted(words.first, first[k], side="right")) - 1
                        hits.setdefault((d, family), []).append((float(p[k, best[k]]), share, int(first[k] - words.first[d]), int(end[k] - words.first[d])))
                ids = part.column("id")
                rows = [(ids[d].as_py(), f, apart([x[2:] for x in h]), max(x[0] for x in h), max(x[1] for x in h), min(x[2] for x in h)) for (d, f), h in hits.items()]
                yield record_batch(FOUND, **dict(zip(FOUND.names, map(list, zip(*rows, strict=True)) if rows else [[]] * len(FOUND.names), strict=True)))

    return df.select(df[key].cast("bigint").alias("id"), df[text].alias("text")).mapInArrow(run, spark_schema(FOUND))


def licences(df: DataFrame, key: str = "doc_id", text: str = "text", negatives: int = NEGATIVES) -> DataFrame:
    """Fits on ``TEMPLATES`` and at most ``negatives`` corpus paragraphs, and scans all of ``df``."""
    docs = df.select(df[key].cast("bigint").alias("id"), df[text].alias("text"))
    return scan(df, fit(df.sparkSession, noise_paragraphs(docs, negatives)), key, text)
