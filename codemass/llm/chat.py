"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log of events is partitioned by conversation, sorted by sequence and folded into final messages:
``message`` starts a message, ``delta`` appends streamed text to its turn's message, ``edit`` replaces that message's
text, and ``regenerate`` discards all messages of its turn and later ones and starts its turn's message anew.
The final messages are rendered under a template whose marks cannot occur inside an escaped text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What the template is made of.  STRINGS are the strings that other templates use for control.
TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
#: Escapes: the backslash first, then the character that starts each control string.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\s"))


def escape(text: Column) -> Column:
    """The text without any '<' or '[', so without control strings; reversible."""
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    """The text that was escaped."""
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def reconstruct(events: DataFrame, *, conversation: str = "conv_id", sequence: str = "seq") -> DataFrame:
    """Final messages of each conversation: conversation, messages array<struct<turn, role, text>> in turn order.

    ``events`` has conversation, sequence, kind, turn, role and text.  Null text counts as empty, null kind as ``message``,
    null role as ""; a null turn comes before all others.  Events of equal sequence follow turn, role, text, then kind.  Every
    ``message`` row is a message of its own, so repeated rows are kept, in the order of the log within a turn.  A delta or
    an edit goes to its turn's latest message and starts one (with its role) where the turn has none, or has none
    left after a regeneration.  A null conversation is one like others.

    The log is shuffled once, by conversation; a fold is windows and grouped sums over sorted events, linear in them.
    """
    e = events.select(
        F.col(conversation).alias("_conv"), F.col(sequence).alias("_seq"), F.col("turn").cast("long").alias("_turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("_role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"),
        F.coalesce(F.col("kind").cast("string"), F.lit("message")).alias("_kind"),
    )
    e = e.withColumn("_n", F.row_number().over(W.partitionBy("_conv").orderBy("_seq", "_turn", "_role", "_text", "_kind")))
    # a regeneration discards what came before it in its own turn and in later turns
    upto = W.partitionBy("_conv").orderBy("_turn").rangeBetween(W.unboundedPreceding, W.currentRow)
    e = e.withColumn("_cut", F.max(F.when(F.col("_kind") == "regenerate", F.col("_n"))).over(upto)).where("_cut is null or _n >= _cut")
    by = W.partitionBy("_conv", "_turn").orderBy("_n")
    start = F.col("_kind").isin("message", "regenerate") | (F.row_number().over(by) == 1)
    e = e.withColumn("_start", start)
    so_far = by.rowsBetween(W.unboundedPreceding, W.currentRow)
    e = e.withColumns({
        "_message": F.sum(F.col("_start").cast("long")).over(so_far),
        "_reset": F.sum((F.col("_start") | (F.col("_kind") == "edit")).cast("long")).over(so_far),
    })
    # the text since a start or an edit, then each message's latest such text
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_text"))), lambda x: x["_text"]), "")
    texts = e.groupBy("_conv", "_turn", "_message", "_reset").agg(F.min("_n").alias("_n"), F.min_by("_role", "_n").alias("_role"), joined.alias("_text"))
    done = texts.groupBy("_conv", "_turn", "_message").agg(
        F.min("_n").alias("_n"), F.min_by("_role", "_n").alias("_role"), F.max_by("_text", "_reset").alias("_text")
    )
    ordered = F.array_sort(F.collect_list(F.struct("_turn", "_n", "_role", "_text")))
    plain = F.transform(ordered, lambda m: F.struct(m["_turn"].alias("turn"), m["_role"].alias("role"), m["_text"].alias("text")))
    return done.groupBy("_conv").agg(plain.alias("messages")).withColumnRenamed("_conv", conversation)


def render(messages: DataFrame, column: str = "messages") -> DataFrame:
    """``messages`` with formatted: each turn as TURN role BODY text END, role and text escaped."""
    turn = F.transform(column, lambda m: F.concat(F.lit(TURN), escape(m["role"]), F.lit(BODY), escape(m["text"]), F.lit(END)))
    return messages.withColumn("formatted", F.array_join(turn, ""))


def read_back(formatted: DataFrame, column: str = "formatted") -> DataFrame:
    """``formatted`` with turns (role, text, masked): parsed from the rendered text, unescaped.

    masked: whether the loss mask covers the turn's text, which is so for the assistant's turns.
    """
    parts = F.filter(F.split(F.col(column), "<\\|turn\\|>", -1), lambda p: p != "")
    turn = F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring_index(p, BODY, 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(p, BODY, -1), END, 1)).alias("text"),
        ),
    )
    turns = F.transform(turn, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), (t["role"] == "assistant").alias("masked")))
    return formatted.withColumn("turns", turns)


def format_chats(events: DataFrame, *, conversation: str = "conv_id", sequence: str = "seq") -> DataFrame:
    """One row for each conversation: conversation, messages, formatted.  An empty log gives no rows."""
    return render(reconstruct(events, conversation=conversation, sequence=sequence))
