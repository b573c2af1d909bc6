"""Quality rules from tokeniser fertility.

A public vocabulary is applied to every word of a text on its own. Characters
per token, the share of tokens that are raw bytes (characters the vocabulary
does not know), the share of words that are one token and the entropy of the
tokens tell prose from junk; each has a band per language, or per script where
the language is unknown. Prose of every language has words that the vocabulary
knows whole; encoded data, keys and random letters fall into fragments.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from provenor.llm.grammar import ragged
from provenor.llm.packing import record_batch, spark_schema
from provenor.llm.spm import Numbers
from provenor.llm.words import HASHED_BYTES, Words, run_hash, slices

SYMBOLS = "#*$%&|<>"
REPEAT_WORDS = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
ENCODED_AT_ONCE = 1 << 14

#: Lowest and highest characters per token, highest share of byte tokens, lowest entropy of the tokens in bits as a share
#: of the highest that so many tokens can have, lowest share of words that are one token.
BANDS: dict[str, tuple[float, ...]] = {
    "en": (1.0, 8.0, 0.20, 0.71, 0.10),
    "de": (1.0, 8.0, 0.20, 0.71, 0.10),
    "fr": (1.0, 8.0, 0.20, 0.71, 0.10),
    "es": (1.0, 8.0, 0.20, 0.71, 0.10),
    "latin": (1.0, 8.0, 0.25, 0.65, 0.05),
    "other": (0.20, 8.0, 1.00, 0.40, 0.0),
}

OUT = pa.schema([
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("chars_per_token", pa.float64()), ("byte_share", pa.float64()), ("token_entropy", pa.float64()),
    ("band", pa.string()), ("whole_share", pa.float64()),
])


def repeat_words(words: np.ndarray, n: int = REPEAT_WORDS) -> int:
    """Words that stand in an ``n``-word run found twice or more in the text, the first one included."""
    runs = run_hash(words, n)
    if not len(runs):
        return 0
    _, back, times = np.unique(runs, return_inverse=True, return_counts=True)
    at = np.flatnonzero(times[back] > 1)
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + n, -1)
    return int((np.cumsum(marks) > 0).sum())


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def band_of(lang: str | None, text_chars: int, latin_chars: int, bands: Mapping[str, tuple]) -> str:
    if lang in bands:
        return lang
    return "latin" if 2 * latin_chars >= text_chars else "other"


def in_band(band: tuple, chars_per_token: float, byte_share: float, entropy: float, tokens: int, whole: float) -> bool:
    low, high, most_bytes, least_entropy, *least_whole = band
    most = np.log2(tokens) if tokens > 1 else 1.0
    return bool(low <= chars_per_token <= high and byte_share <= most_bytes and entropy >= least_entropy * min(most, 8.0) and all(whole >= x for x in least_whole))


class Fertility:
    """Token ids of words in one array, remembered for the words of a task's recent slices. Words are told apart by 64-bit hashes."""

    def __init__(self, model: bytes, remember: int = 400_000):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.is_byte = np.array([self.sp.IsByte(i) for i in range(self.sp.GetPieceSize())])
        self.remember = remember
        self._forget(remember)

    def _forget(self, most: int) -> None:
        """Room for so many words, none of them known."""
        self.numbers, self.count, self.most = Numbers(most), 0, most
        self.begin, self.pool = np.zeros(most + 1, np.int64), np.zeros(4 * most, np.int32)

    def _encode(self, words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words at these places one after the other, and their number for each."""
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for k in range(0, len(at), ENCODED_AT_ONCE):
            some = at[k : k + ENCODED_AT_ONCE]
            found = self.sp.encode([words.data[a:b].tobytes().decode("utf-8") for a, b in zip(words.start[some], words.end[some], strict=True)], num_threads=1)
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), np.int32, int(sizes[-1].sum())))
        return np.concatenate(ids), np.concatenate(sizes)

    def know(self, words: Words) -> np.ndarray:
        """The number of each word; what was known before is forgotten when there is no more room."""
        number = self.numbers.get(words.hash)
        missing = np.flatnonzero(number < 0)
        if not len(missing):
            return number
        new, first = np.unique(words.hash[missing], return_index=True)
        if self.count and self.count + len(new) > self.most:
            self._forget(self.remember)
            return self.know(words)
        if len(new) > self.most:
            self._forget(len(new))
        ids, sizes = self._encode(words, missing[first])
        to, used = np.arange(self.count, self.count + len(new)), int(self.begin[self.count])
        if used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[:used], np.zeros(max(used, 2 * len(ids)), np.int32)])
        self.pool[used : used + len(ids)] = ids
        self.begin[to + 1] = used + np.cumsum(sizes)
        self.numbers.put(new, to.astype(np.int32))
        self.count += len(new)
        return self.numbers.get(words.hash)

    def ids(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and their number for each word."""
        sizes = self.begin[number + 1] - self.begin[number]
        return self.pool[ragged(self.begin[number], sizes)], sizes


def measure(words: Words, number: np.ndarray, d: int, lang: str | None, fertility: Fertility, bands: Mapping[str, tuple]) -> tuple:
    raw = words.text(d)
    text, parts = raw.decode("utf-8"), raw.split()
    n, chars = len(parts), len(b"".join(parts).decode("utf-8"))
    repeated = repeat_words(words.hash[words.first[d] : words.first[d + 1]])
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
    cpt = share = entropy = whole = 0.0
    latin = max(sum(text.count(c) for c in "aeiounrst") * 2, int((np.frombuffer(b"".join(parts), np.uint8) < 128).sum())) if lang not in bands else 0
    band = band_of(lang, chars, latin, bands)
    kept = False
    if n:
        ids, sizes = fertility.ids(number[words.first[d] : words.first[d + 1]])
        whole = int((sizes <= 1).sum()) / n
        ids = ids[ids >= 0]
        tokens = len(ids)
        p = np.unique(ids, return_counts=True)[1] / tokens
        cpt, share, entropy = chars / tokens, float(fertility.is_byte[ids].mean()), float(-(p * np.log2(p)).sum())
        kept = not failed and in_band(bands[band], cpt, share, entropy, tokens, whole)
    return n, chars, sum(text.count(c) for c in SYMBOLS), dup_lines(text), repeated, failed, kept, cpt, share, entropy, band, whole


def model_bytes(spark, path: str) -> bytes:
    """The vocabulary file at ``path``: a local path of the driver, or a URI that Spark reads."""
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def quality_rules(
    df: DataFrame,
    model: bytes,
    text: str = "text",
    lang: str | None = "lang",
    bands: Mapping[str, tuple] = BANDS,
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """Each row of ``df`` with its measures and the verdict ``kept``.

    ``keep`` lists the columns of ``df`` to return (all by default); a column of
    ``df`` that has the name of a measure gives way to the measure. A null or
    empty text, or one of white space only, has no words and is not kept. Rows
    that repeat are judged alike, an empty table gives an empty one. Bands must
    have ``latin`` and ``other`` for rows of unknown or null language, ``latin`` being
    for texts that are half ASCII or more, too; the lowest share of words that are
    one token may be left out of a band. The model
    (under 1 MB) travels with the tasks; nothing is shuffled.
    """
    measures = set(OUT.names)
    keep = tuple(c for c in (df.columns if keep is None else keep) if c not in measures)
    used = [text if text in keep else "__text", "__lang"]  # a text to return goes to the tasks once
    source = df.select(*keep, *([] if text in keep else [df[text].alias(used[0])]), (df[lang] if lang else df[text].substr(1, 0)).alias(used[1]))
    extra = df.select(*keep).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in extra), spark_schema(OUT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = Fertility(model)
        for batch in batches:
            for part in slices(batch, used[0], HASHED_BYTES):
                words = Words(part.column(used[0]), lower=False)
                langs, number = part.column(used[1]).to_pylist(), fertility.know(words)
                rows = [measure(words, number, d, langs[d], fertility, bands) for d in range(part.num_rows)]
                values = zip(*rows, strict=True) if rows else [[] for _ in OUT]
                made = record_batch(OUT, **{f.name: list(v) for f, v in zip(OUT, values, strict=True)})
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made.columns], names=[*keep, *OUT.names])

    return source.mapInArrow(run, schema)
