"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A conversation becomes one string in which every turn is marked. Each assistant turn then becomes an
example of its own: the context holds all turns before it, and only the reply's text is trainable.
Turns after the last assistant turn (or a conversation without one) give one more row with no target,
so that the examples of a conversation hold all of it.

Defined cases: a null role or text counts as empty; rows of a conversation go by (turn, role, text), a
null turn first, and repeated rows are turns of their own; a null conv_id is a conversation like any
other; an empty table gives an empty result; other columns of the input are not looked at.
A conversation is one value of one row, so it has to fit Spark's limit of 2 GB for a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template: OPEN role MID text CLOSE for each turn.
OPEN, MID, CLOSE = "<s>[INST]", "[/INST]", "</s>"

#: A control string, or one with back-slashes behind its first sign. Escaping adds a back-slash there and
#: unescaping takes one away, so that no escaped text holds a control string and every text comes back.
CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def format_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted string, turns array of (role, text_start, text_end).

    text_start and text_end are code point offsets of the escaped text in formatted.
    """
    marked = rows.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).select(
        "*",
        F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MID)).alias("head"),
        escape(F.col("text")).alias("body"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    close = F.lit(len(CLOSE))
    size = F.length("head") + F.length("body") + close
    placed = marked.select(
        "conv_id",
        "role",
        F.concat("head", "body", F.lit(CLOSE)).alias("piece"),
        F.length("body").alias("n"),
        F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias("end"),
    )
    turn = F.struct(
        "end",
        "piece",
        "role",
        (F.col("end") - close - F.col("n")).alias("text_start"),
        (F.col("end") - close).alias("text_end"),
    )
    return (
        placed.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"))
        .select(
            "conv_id",
            F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
            F.transform(
                "turns", lambda t: F.struct(t["role"].alias("role"), t["text_start"].alias("text_start"), t["text_end"].alias("text_end"))
            ).alias("turns"),
        )
    )


def prefix_targets(rows: DataFrame, assistant: str = "assistant") -> DataFrame:
    """Examples: conv_id, example (from 0), n_examples, trainable, context, target.

    context + target is a prefix of the formatted conversation that ends with the reply's closing mark;
    the loss mask covers target without that mark (loss_start to loss_end, code points of context + target).
    The row of trailing turns has trainable = false and an empty target.
    """
    conv = format_conversations(rows)
    replies = F.transform(
        F.filter("turns", lambda t: t["role"] == F.lit(assistant)),
        lambda t: F.struct(t["role"].alias("role"), t["text_start"].alias("a"), t["text_end"].alias("b")),
    )
    end, close = F.length("formatted"), F.lit(len(CLOSE))
    tail = F.struct(F.lit(None).cast("string").alias("role"), end.alias("a"), end.alias("b"))
    read = F.coalesce(F.try_element_at(F.col("targets"), F.lit(-1))["b"] + close, F.lit(0))
    targets = F.when(read < end, F.concat("targets", F.array(tail))).otherwise(F.col("targets"))
    return (
        conv.withColumn("targets", replies)
        .withColumn("targets", targets)
        .withColumn("n_examples", F.size("targets"))
        .select("conv_id", "formatted", "n_examples", F.posexplode("targets").alias("example", "t"))
        .select(
            "conv_id",
            "example",
            "n_examples",
            F.col("t.role").isNotNull().alias("trainable"),
            F.substring(F.col("formatted"), F.lit(1), F.col("t.a")).alias("context"),
            F.when(
                F.col("t.role").isNotNull(),
                F.substring(F.col("formatted"), F.col("t.a") + 1, F.col("t.b") - F.col("t.a") + close),
            )
            .otherwise(F.lit(""))
            .alias("target"),
            F.col("t.a").alias("loss_start"),
            F.col("t.b").alias("loss_end"),
        )
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string, as an array of (role, text), unescaped."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != F.lit(""))
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring(F.substring_index(p, MID, 1), len(OPEN) + 1, 2**31 - 1)).alias("role"),
            unescape(F.substr(p, F.locate(MID, p) + F.lit(len(MID)))).alias("text"),
        ),
    )


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, what reading its examples gives back: the whole of it, and all text under the loss mask."""
    whole = F.when(F.col("example") == F.col("n_examples") - 1, F.concat("context", "target"))
    # The mask is a range of context + target; the reply is the part of target that lies in it.
    masked = F.substring(
        F.col("target"),
        F.col("loss_start") - F.length("context") + 1,
        F.col("loss_end") - F.col("loss_start"),
    )
    read = (
        examples.groupBy("conv_id")
        .agg(
            F.max(whole).alias("formatted"),
            F.array_sort(
                F.collect_list(F.when(F.col("trainable"), F.struct("example", unescape(masked).alias("text"))))
            ).alias("losses"),
        )
        .withColumn("turns", read_turns(F.col("formatted")))
        .withColumn("loss", F.array_join(F.transform("losses", lambda x: x["text"]), ""))
    )
    lines = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
