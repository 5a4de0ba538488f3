"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role are merged into one block:

    <|im_start|>role\\ntext<|im_sep|>text<|im_end|>\\n

In roles and texts every ``<|`` gets a backslash between its characters (and ``<\\|`` one more), so that no text can hold a
marker and unescaping gives back the exact text. In roles, line feeds and backslashes are written as \\n and \\\\ too.
The loss mask is a list of (start, end) ranges, in code points of the formatted text: the texts of assistant turns.

Defined results: null texts and roles are empty; turns are in order of (turn, role, text), nulls first, and equal rows
stay; a null conversation id is a conversation; very long texts are one turn as any other; an empty table gives an empty
result; other columns are not looked at. A conversation's result is one string, so all its turns meet in one row, as the
output demands, and a conversation is bounded by the 2 GB of a string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import substrings, sums_before

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    parts = F.transform(F.split(unescape(role), r"\\\\", -1), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss array<struct<start, end>>), a row a conversation."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = turns.select(F.col(id_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    role = lambda k: F.element_at("turns", k)["role"]
    df = df.withColumn("starts", F.filter(F.sequence(F.lit(1), F.size("turns")), lambda k: F.when(k == 1, True).otherwise(role(k) != role(F.greatest(k - 1, F.lit(1))))))
    block_end = lambda j: F.coalesce(F.try_element_at("starts", j + 2), F.size("turns") + 1)
    texts = lambda s, j: F.transform(F.slice("turns", s, block_end(j) - s), lambda x: escape(x["text"]))
    df = df.withColumn("blocks", F.transform("starts", lambda s, j: F.struct(role(s).alias("role"), texts(s, j).alias("texts"))))
    piece = lambda text, learnt: F.struct(text.alias("text"), learnt.alias("learnt"))
    no = F.lit(False)

    def pieces(b):
        inner = F.flatten(F.transform(b["texts"], lambda x, k: F.array(piece(F.when(k == 0, "").otherwise(SEP), no), piece(x, b["role"] == learn))))
        return F.concat(F.array(piece(F.concat(F.lit(START), escape_role(b["role"]), F.lit("\n")), no)), inner, F.array(piece(F.lit(END + "\n"), no)))

    df = df.withColumn("pieces", F.flatten(F.transform("blocks", pieces)))
    df = df.withColumn("lengths", F.transform("pieces", lambda x: F.length(x["text"]).cast("long")))
    df = sums_before(df, "lengths", "at")
    placed = F.filter(F.arrays_zip("pieces", "at"), lambda x: x["pieces"]["learnt"])
    loss = F.transform(placed, lambda x: F.struct(x["at"].alias("start"), (x["at"] + F.length(x["pieces"]["text"])).alias("end")))
    return df.select("conv_id", F.array_join(F.transform("pieces", lambda x: x["text"]), "").alias("formatted"), loss.alias("loss"))


def parse_chats(chats: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, learnt array<string>) read back from the formatted text and the mask."""
    blocks = F.slice(F.split("formatted", r"<\|im_end\|>\n", -1), F.lit(1), F.size(F.split("formatted", r"<\|im_end\|>\n", -1)) - 1)

    def turns_of(b):
        head = F.instr(b, "\n")
        role = unescape_role(F.substring(b, F.lit(len(START) + 1), head - len(START) - 1))
        return F.transform(F.split(F.substring(b, head + 1, F.length(b)), r"<\|im_sep\|>", -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    learnt = F.transform(substrings(F.col("formatted"), F.col("loss")), unescape)
    return chats.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), F.flatten(F.transform(blocks, turns_of)).alias("turns"), learnt.alias("learnt"))


def summary(chats: DataFrame) -> DataFrame:
    back = parse_chats(chats)
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    learnt = F.array_join("learnt", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), "formatted_chars")
