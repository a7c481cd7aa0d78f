"""Chat formatting: turns of a conversation to one training text with a loss mask, and back. Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TRAINED = ("assistant",)
_SPANS = "array<struct<start:int,length:int>>"


def escape(c: Column) -> Column:
    r"""One backslash more inside every `<|`, `<\|`, `<\\|` ...: no control string can be left in a text."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def _escape_role(c: Column) -> Column:
    return escape(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(c: Column) -> Column:
    return F.replace(F.replace(unescape(c), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chats(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: tuple[str, ...] = TRAINED
) -> DataFrame:
    """One row a conversation: conv, n_blocks, formatted, loss_spans (start and length in code points of `formatted`, from 0).

    A conversation's turns are collected as structs and sorted by turn, then role, then text. Neighbours of one role are merged
    into one block `<|im_start|>role` LF text `<|im_sep|>` text ... `<|im_end|>` LF, so that the mark between merged turns keeps
    the source turns readable. Every text of a role in `trained` is a span of the mask, marks excluded.

    Null text or role: empty. Null turn: sorts first. Null conversation id: a conversation of its own. Repeated rows: kept, as
    repeated turns. Empty table: no rows. Other columns are ignored. A conversation is one row by contract; its size is bounded
    by that row, not by the table.
    """
    rows = turns.select(
        F.col(conv).alias("conv"),
        F.struct(
            F.col(turn).alias("turn"),
            _escape_role(F.coalesce(F.col(role), F.lit(""))).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("raw"),
            escape(F.coalesce(F.col(text), F.lit(""))).alias("text"),
            F.coalesce(F.col(role), F.lit("")).isin(*trained).alias("loss"),
        ).alias("t"),
    )
    chats = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    other = lambda t, i: ~F.coalesce(F.get(F.col("ts"), i)["role"].eqNullSafe(t["role"]), F.lit(False))
    parts = F.transform(
        "ts",
        lambda t, i: F.struct(
            F.when(other(t, i - 1), F.concat(F.lit(START), t["role"], F.lit("\n"))).otherwise(F.lit(SEP)).alias("before"),
            t["text"].alias("text"),
            F.when(other(t, i + 1), F.lit(END + "\n")).otherwise(F.lit("")).alias("after"),
            t["loss"].alias("loss"),
        ),
    )
    chats = chats.select("conv", "ts", parts.alias("parts"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))

    def step(s: Column, p: Column) -> Column:
        begin, n = s["at"] + F.length(p["before"]), F.length(p["text"])
        span = F.array(F.struct(begin.alias("start"), n.alias("length")))
        return F.struct((begin + n + F.length(p["after"])).alias("at"), F.when(p["loss"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return chats.select(
        F.col("conv").alias(conv),
        F.size(F.filter("parts", lambda p: p["before"] != SEP)).alias("n_blocks"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["before"], p["text"], p["after"])), "").alias("formatted"),
        F.aggregate("parts", start, step, lambda s: s["spans"]).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns in a formatted text: array of struct(role, text), merged neighbours apart again."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")

    def turns(block: Column) -> Column:
        at = F.instr(block, "\n")
        role = block.substr(F.lit(len(START) + 1), at - len(START) - 1)
        body = block.substr(at + 1, F.length(block))
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda x: F.struct(_unescape_role(role).alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the mask, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr(s["start"] + 1, s["length"]))), "")
