"""String helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from provenor import constants as K


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_key(c: Column | str, strip_inner: bool = False) -> Column:
    """Upper-cased join key; ``strip_inner`` also removes white space inside."""
    key = F.trim(_col(c).cast("string"))
    if strip_inner:
        key = F.regexp_replace(key, r"\s+", "")
    return F.upper(key)


def not_blank(c: Column | str) -> Column:
    """True when the text is present and holds more than spaces."""
    return F.coalesce(F.length(F.trim(_col(c))) > 0, F.lit(False))


def blank(c: Column | str) -> Column:
    return ~not_blank(c)


def id_parts(
    c: Column | str, flag_suffix: str = K.PAR_Y_SUFFIX, version: str = K.VERSION_SUFFIX
) -> tuple[Column, Column]:
    """(flag, base): whether the suffix is present, and the id without suffix and version."""
    raw = _col(c)
    flag = raw.endswith(flag_suffix)
    stem = F.when(flag, F.left(raw, F.length(raw) - F.lit(len(flag_suffix)))).otherwise(raw)
    return flag, F.regexp_replace(stem, version, "")


def extract_id(c: Column | str, pattern: str, group: int = 1) -> Column:
    """First capture of ``pattern``; null when it does not occur."""
    return F.nullif(F.regexp_extract(_col(c).cast("string"), pattern, group), F.lit(""))


def label_group(
    *cols: Column | str,
    rules: Sequence[tuple[str, str]] = tuple(K.GROUP_RULES),
    default: str = K.GROUP_DEFAULT,
) -> Column:
    """Label of the first rule whose pattern occurs in the lower-cased, joined texts."""
    text = F.lower(F.concat_ws(" ", *[_col(c).cast("string") for c in cols]))
    label = None
    for name, pattern in rules:
        hit = text.rlike(pattern)
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return F.lit(default) if label is None else label.otherwise(default)


def csv_guard(c: Column | str) -> Column:
    """Text that a spreadsheet will not read as a formula; null becomes empty."""
    text = F.coalesce(_col(c).cast("string"), F.lit(""))
    return F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def embedding_text(title: Column | str, text: Column | str) -> Column:
    return F.concat(F.lit("title: "), _col(title), F.lit(" | text: "), _col(text))


def question_text(question: Column | str) -> Column:
    """The text of a question that is embedded, in the form that goes with ``embedding_text``."""
    return F.concat(F.lit("task: question answering | query: "), _col(question))


def file_name(path: Column | str) -> Column:
    """Last element of a path."""
    return F.substring_index(_col(path), "/", -1)
