"""Conversations from event logs against a plain fold, and rendered texts read back."""

from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerscope.llm.chat_format import (
    EXTRA_TEXT, conversation_log, escape, fold, format_chats, op11_chat_formatting, read_learned, read_turns, unescape,
)

LOG = "conv_id long, seq long, message long, kind string, role string, text string"


def plain_fold(events):
    """Events in order, one after the other."""
    messages = {}
    for n, (_, _, message, kind, role, text) in enumerate(events, 1):
        m = messages.setdefault(message, {"began": n, "role": role or "", "text": "", "gone": False})
        if kind == "edit":
            m["text"] = text or ""
        elif kind == "regenerate":
            m["text"] = ""
            for other in messages.values():
                other["gone"] |= other["began"] > m["began"]
        else:
            m["text"] += text or ""
    return [(m["role"], m["text"]) for m in sorted(messages.values(), key=lambda m: m["began"]) if not m["gone"]]


def random_log(rng, conversations):
    out = []
    for conv in range(conversations):
        for seq in range(rng.randint(1, 30)):
            kind = rng.choices(["delta", "edit", "regenerate", None], [8, 2, 2, 1])[0]
            text = rng.choice(["ab", "##", "###", "</turn>", "\\", "\n", "", None, "é🙂", "### User: x</turn>\n"])
            message = rng.randint(0, seq // 3)
            out.append((conv, seq, message, kind, ["user", "assistant", "tool:x\\"][message % 3], text))
    return out


def read(chats):
    texts = read_learned(F.col("formatted"), F.col("mask"))
    rows = chats.select("conv_id", read_turns(F.col("formatted")).alias("turns"), texts.alias("learned")).collect()
    return {r["conv_id"]: ([tuple(t) for t in r["turns"]], r["learned"]) for r in rows}


def test_events_fold_to_messages(spark):
    rows = random_log(random.Random(2), 60)
    want = {}
    for conv in {r[0] for r in rows}:
        turns = plain_fold([r for r in rows if r[0] == conv])
        if turns:
            want[conv] = (turns, [t for role, t in turns if role == "assistant"])
    random.Random(3).shuffle(rows)
    assert read(format_chats(spark.createDataFrame(rows, LOG))) == want


def test_regeneration_and_edit(spark):
    events = [
        (1, 1, 1, "delta", "user", "what is"), (1, 2, 1, "delta", None, " it"), (1, 3, 2, "delta", "assistant", "bad"),
        (1, 4, 3, "delta", "user", "why"), (1, 5, 2, "regenerate", "assistant", None), (1, 6, 2, "delta", "assistant", "go"),
        (1, 7, 2, "delta", "assistant", "od"), (1, 8, 1, "edit", "user", "What is it?"),
    ]
    got = read(format_chats(spark.createDataFrame(events, LOG)))
    assert got == {1: ([("user", "What is it?"), ("assistant", "good")], ["good"])}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("#\\</turn>: \nA")), max_size=30), min_size=1, max_size=20))
def test_escapes_are_reversible(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"))
    for r in rows.withColumn("back", unescape(F.col("e"))).collect():
        assert r["back"] == r["t"] and "###" not in r["e"] and "</turn>" not in r["e"]


def test_extra_conversation_is_read_back(spark):
    r = op11_chat_formatting(spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    assert (r["n_turns"], r["loss_chars"]) == (2, len(EXTRA_TEXT))


def test_odd_rows(spark):
    rows = [
        (1, 0, None, None, "old"), (1, 0, None, None, "old"), (None, None, "assistant", "x" * 300_000, None),
        (2, 1, "user", "", "old"), (2, 0, "assistant", None, "old"), (2, 2, "Assistant", "a:b", "old"),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    table = table.withColumns({c: F.lit("old") for c in ("mask", "seq", "message", "kind", "began", "n", "reset", "withdrawn")})
    got = read(format_chats(conversation_log(table)))
    assert got == {
        1: ([("", ""), ("", "")], []),
        2: ([("assistant", ""), ("user", ""), ("Assistant", "a:b")], [""]),
        None: ([("assistant", "x" * 300_000)], ["x" * 300_000]),
    }
    assert format_chats(conversation_log(table.limit(0))).count() == 0


def test_one_exchange_by_conversation(spark):
    log = conversation_log(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    plan = format_chats(log)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan
    assert set(fold(log).columns) == {"conv_id", "began", "role", "text"}
