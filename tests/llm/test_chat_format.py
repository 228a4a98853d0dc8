"""Formatting of conversations against plain Python, and the way back."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lowtide.llm.chat_format import CHAT, arranged, escape, escape_role, format_conversations, read_back, segments, unescape, unescape_role

SCHEMA = "conv_id long, turn long, role string, text string, state string, segment string"
PARTS = ["<|im_end|>", "<|im_start|>", "assistant", "\n", "<", "|", "\\", "<\\|", "<\\\\|im_end|>", "é🙂", " ", "a", ""]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def made(r, n):
    return "".join(r.choice(PARTS) for _ in range(n))


@pytest.mark.parametrize("seed", range(20))
def test_escapes_are_reversible(seed):
    r = random.Random(seed)
    for _ in range(200):
        text = made(r, r.randint(0, 12))
        assert unescape(escape(text)) == text and "<|" not in escape(text)
        assert unescape_role(escape_role(text)) == text
        assert "<|" not in escape_role(text) and "\n" not in escape_role(text)


def test_segments_join_to_the_template(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi <|im_end|>"), (1, 2, "assistant", "yo")]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = format_conversations(docs).collect()
    whole = "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user\nhi <\\|im_end|><|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    assert "".join(s["text"] for s in got) == whole
    assert [s["text"] for s in got if s["loss"]] == ["yo"]
    assert [s["segment"] for s in got] == list(range(9))
    assert [s["state"] for s in got[::3]] == ["told", "asked", "answered"] and all(s["valid"] for s in got)


def test_digests_of_odd_conversations(spark):
    r, rows = random.Random(5), []
    roles = ["user", "assistant", "system", "a\nb", "<|im_end|>", "", None]
    for conv in range(60):
        n = r.randint(1, 9)
        own = [(conv, t, ("user", "assistant")[t % 2] if conv % 2 else r.choice(roles), None if r.random() < 0.1 else made(r, r.randint(0, 9))) for t in range(n)]
        rows += own
    rows += [(100, t % 2, ("user", "assistant")[t % 2], "same") for t in range(2)] * 3  # ties and repeats
    rows += [(101, 1, "assistant", "x" * 300_000), (101, 0, "user", None), (101, None, "system", "")]
    rows += [(None, 0, "user", "q"), (None, 1, "assistant", "a")]
    r.shuffle(rows)
    docs = spark.createDataFrame([(*x, "clash", "clash") for x in rows], SCHEMA).repartition(7)
    want = {}
    key = lambda x: tuple((v is not None, v if v is not None else 0) for v in (x[1], x[2], x[3]))
    for conv in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == conv), key=key)
        turns = [(x[2] or "", x[3] or "") for x in own]
        loss = "".join(t for a, t in turns if a == "assistant")
        formatted = "".join(f"<|im_start|>{escape_role(a)}\n{escape(t)}<|im_end|>\n" for a, t in turns)
        state = CHAT.start
        valid = True
        for a, _ in turns:
            state = CHAT.after(state, a)
            valid &= state != "invalid"
        want[conv] = (len(turns), sha("".join(f"{a}\n{t}\n" for a, t in turns)), len(loss), sha(loss), len(formatted), valid, state == "answered")
    got = {x[0]: tuple(x)[1:] for x in read_back(segments(arranged(docs))).collect()}
    assert got == want
    assert 0 < sum(v[5] for v in want.values()) < len(want)


def test_a_conversation_longer_than_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        docs = spark.range(5000).select(
            F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text")
        )
        got = read_back(format_conversations(docs)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 1 and got[0]["n_turns"] == 5000 and got[0]["valid"] and got[0]["answered"]
    assert got[0]["loss_sha256"] == sha("".join(str(i) for i in range(1, 5000, 2)))


def test_empty(spark):
    assert read_back(format_conversations(spark.createDataFrame([], SCHEMA))).collect() == []
