"""Chat formatting with Spark expressions only.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. Adjacent turns of one role
become one block whose texts are parted by ``<|im_sep|>``. In texts a backslash
is doubled and ``<|`` becomes ``<\\|``, so no marker can occur inside a text and
the original is found again by dropping one backslash from each pair; a line
break inside a role is written ``<|nl|>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END, BREAK = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n", "<|nl|>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_chats(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant"
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``loss_spans``.

    Turns are ordered by (turn, role, text); null turns come first and null
    roles and texts count as empty, so equal or repeated rows have a defined
    order and each stays a turn of its own. Rows with a null conversation form
    one conversation. Other columns are not read. ``loss_spans`` holds zero-based
    start and length, in code points of ``formatted``, of each text of
    ``loss_role``. A conversation is one output string, so its turns meet in one
    group; nothing else does.
    """
    turns = df.select(
        df[conv].alias("conv_id"),
        F.struct(
            df[turn].alias("turn"), F.coalesce(df[role].cast("string"), F.lit("")).alias("role"), F.coalesce(df[text].cast("string"), F.lit("")).alias("text")
        ).alias("t"),
    )
    sorted_turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        """What stands before the text of a turn, and the text."""
        new = (i == 0) | (F.get(F.col("turns"), i - 1)["role"] != t["role"])
        header = F.concat(F.lit(START), F.replace(escape(t["role"]), F.lit("\n"), F.lit(BREAK)), F.lit("\n"))
        before = F.when(i == 0, header).when(new, F.concat(F.lit(END), header)).otherwise(F.lit(SEP))
        return F.struct(before.alias("before"), escape(t["text"]).alias("text"), (t["role"] == loss_role).alias("loss"))

    pieces = sorted_turns.select("conv_id", F.transform("turns", piece).alias("pieces"))
    body = F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"])), "")
    empty = F.array().cast("array<struct<start:bigint,length:bigint>>")

    def walk(acc: Column, p: Column) -> Column:
        at, size = acc["at"] + F.length(p["before"]), F.length(p["text"]).cast("bigint")
        span = F.array(F.struct(at.alias("start"), size.alias("length")))
        return F.struct((at + size).alias("at"), F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("pieces", F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("spans")), walk, lambda acc: acc["spans"])
    return pieces.select("conv_id", F.concat(body, F.lit(END)).alias("formatted"), spans.alias("loss_spans"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """The turns and the loss text found in the output of ``format_chats``: ``conv_id``, ``turns``, ``loss_text``, ``formatted``."""
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        inner = F.substring(block, len(START) + 1, F.length(block))
        role = unescape(F.replace(F.substring_index(inner, "\n", 1), F.lit(BREAK), F.lit("\n")))
        body = F.substring(inner, F.length(F.substring_index(inner, "\n", 1)) + 2, F.length(inner))
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select(
        "conv_id", F.flatten(F.transform(blocks, turns_of)).alias("turns"), F.array_join(loss, "").alias("loss_text"), F.size(blocks).cast("bigint").alias("n_blocks"), "formatted"
    )
