"""Ends of texts are looked at without walking the texts, and an answer's digits are read at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from sentivote.functions import text as T
from sentivote.plans import fixtures as fx

CHARS = [*T._WS_CHARS, "!", "~", "\x7f", "\x08", "\x1b", "\x84", "\x86", "a", "z", "{", "é", "​", "‧", "😀", "℀", ""]


def test_strip_and_first_characters_over_all_ends(spark):
    texts = [a + m + b for a in CHARS for b in CHARS for m in ("x", "", "é y")] + [None, " \n　"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", T.strip(F.col("t")).alias("s"), T.begins_between(F.col("t"), "a", "z").alias("b")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["s"] == (None if r["t"] is None else r["t"].strip(T._WS_CHARS)), repr(r["t"])
        assert r["b"] == (None if r["t"] is None else "a" <= r["t"][:1] <= "z"), repr(r["t"])


def test_answers_read_their_digits_at_once(spark, sf):
    plan = fx.votes(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "conv(" in plan and "instr(" not in plan
