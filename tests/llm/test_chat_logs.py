"""Random chat logs against a fold of one event after another."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from codemass.llm import chat

SCHEMA = "conv_id long, seq long, kind string, turn long, role string, text string"


def fold(log: list[tuple]) -> list[tuple]:
    """log: (seq, kind, turn, role, text), folded one by one."""
    none = lambda x: (x is not None, x or 0)
    events = sorted(((none(s), none(t), r or "", x or "", k or "message") for s, k, t, r, x in log))
    done: list[list] = []
    for n, (_, turn, role, text, kind) in enumerate(events):
        if kind == "regenerate":
            done = [m for m in done if m[0] < turn]
        mine = [m for m in done if m[0] == turn]
        if kind in ("message", "regenerate") or not mine:
            done.append([turn, n, role, text])
        elif kind == "delta":
            mine[-1][3] += text
        else:
            mine[-1][3] = text
    return [(r, x) for _, _, r, x in sorted(done)]


def test_random_logs_equal_a_fold(spark):
    rnd = random.Random(12)
    rows = []
    for conv in [None, *range(150)]:
        for n in range(rnd.choice([1, 3, 30, 60])):
            kind = rnd.choice(["message", "delta", "delta", "delta", "edit", "regenerate", None] if conv else ["message", "delta"])
            rows.append((conv, rnd.choice([n, n, rnd.randint(0, 5), None]), kind, rnd.choice([0, 1, 2, 3, None]),
                    rnd.choice(["user", "assistant", None]), rnd.choice(["a", "b<", "[c", "", None])))
    rows += rows[:40]
    events = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", messages string, _n int").repartition(5)
    got = {r["conv_id"]: [(m["role"], m["text"]) for m in r["messages"]] for r in chat.reconstruct(events).collect()}
    want = {c: fold([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert got == want
    back = {r["conv_id"]: [(m["role"], m["text"]) for m in r["turns"]] for r in chat.read_back(chat.format_chats(events)).collect()}
    assert back == want


def test_long_logs_are_linear(spark):
    events = spark.range(60_000).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("seq"), F.when(F.col("id") % 100 == 0, "message").otherwise("delta").alias("kind"),
        F.floor(F.col("id") / 100).alias("turn"), F.lit("assistant").alias("role"), F.lit("token ").alias("text"),
    )
    began = time.time()
    row = chat.reconstruct(events).select(F.size("messages").alias("n"), F.length(F.col("messages")[599]["text"]).alias("m")).first()
    assert tuple(row) == (600, 600) and time.time() - began < 20
