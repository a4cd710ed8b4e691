"""What lets work grow with the input only: texts moved once, patterns run where they can match."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from sentivote.functions import text as T
from sentivote.operators import calls, segment
from sentivote.plans import queries

ODD = [
    "", " ", "a", "*a*", "** b **", "![x](y) z", "![x](y)", "[l](u) & co", "&amp;&#12;", "<b>x</b>", '<SPAN id="p">q</span>r', "a\\*b",
    "a  b\tc", "`c` d", "http://a b", "HTTP://a", "_e_ f", "|---|", "-- -", ":--", "---", "== x", "3. n", "٣. n", "é  è", "　x y ",
    "a b", "a\x85b", "😀  😀", "www.a", "xhttps://a/b", "Z", "z_", "\\(", "_", "+ b", "12/3", "١٢",
]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_marks_skip_no_rule(spark):
    df = spark.createDataFrame([(s,) for s in ODD], "s string")
    for rules in (T.MARKUP_REWRITES, T.INLINE_REWRITES):
        plain = F.col("s")
        for pattern, replacement, marks in rules:
            assert marks
            plain = F.regexp_replace(plain, pattern, replacement)
        rows = df.select("s", plain.alias("want"), T.rewrite(F.col("s"), rules).alias("got")).collect()
        assert [(r["s"], r["got"]) for r in rows] == [(r["s"], r["want"]) for r in rows]


def test_first_characters_hide_nothing(spark):
    s = F.col("s")
    trimmed = F.btrim(s, F.lit(T._WS_CHARS))
    noise = (trimmed == "") | trimmed.rlike(T.NOISE)
    squeezed = F.md5(F.regexp_replace(F.btrim(F.lower(s), F.lit(T._WS_CHARS)), f"{T.WS}+", " "))
    df = spark.createDataFrame([(x,) for x in ODD], "s string")
    rows = df.select(
        "s", trimmed.alias("a"), T.strip(s).alias("b"), noise.alias("c"), T.is_noise(s).alias("d"), squeezed.alias("e"), T.fingerprint(s).alias("f"),
        T.is_rule_line(trimmed).alias("g"), trimmed.rlike(T.RULE_LINE).alias("h"), T.is_url_only(trimmed).alias("i"), trimmed.rlike(T.URL_ONLY).alias("j"),
    ).collect()
    for r in rows:
        assert (r.a, r.c, r.e, r.h, r.j) == (r.b, r.d, r.f, r.g, r.i), repr(r.s)


def test_phrases_are_counted_without_paragraphs(spark):
    df = spark.createDataFrame([("d", "# T\na b. Long one here.\n# T\nT\n- x\n- x\n# U\n- X  y\n- x Y")], "k string, text string")
    counted = segment.phrase_counts(df)
    assert "sort_array" not in plan(counted) and counted.first()["n_phrases"] == segment.phrases_flat(df).count()


def test_recorded_replies_are_read_once(spark):
    replies = [(i, q, raw, 10, 2, err) for i, (raw, err) in enumerate([("oui", None), (None, None), ("[1]", None), ("non", "x"), (None, "y")]) for q in "ab"]
    replies = spark.createDataFrame(replies, "i int, q string, raw string, tok_in int, tok_out int, erreur string")
    asked = spark.createDataFrame([(i, q, m) for i in range(7) for q in "ab" for m in "mn"], "i int, q string, model string")
    want = calls.read_answers(calls.answer_from_recorded(asked, replies, ["i", "q"])).drop("raw")
    got = calls.answers_from_recorded(asked, replies, ["i", "q"]).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_prompts_stay_in_python(spark, sf):
    asked = plan(queries.registry()["external_answers"](spark, sf))
    made = re.search(r"MapInArrow .*\[(.*?)\]", asked)
    assert made and "prompt" not in made.group(1)


def test_a_provider_gets_parts_of_a_batch(spark):
    def ask():
        def answer(batch):
            out = batch[[]].copy()
            out["raw"], out["tok_in"], out["tok_out"], out["duration_s"], out["erreur"] = str(len(batch)), 1, 1, 0.0, None
            return out

        return answer

    rows = calls.with_prompts(spark.range(0, 1200, 1, 1), F.col("id").cast("string")).withColumn("model", F.lit("m"))
    got = calls.ask_external(rows, ask, keep=["id"]).collect()
    assert sorted(r["id"] for r in got) == list(range(1200)) and max(int(r["raw"]) for r in got) <= calls.PER_ASK


def test_texts_are_not_moved_with_each_call(spark):
    from sentivote.operators.answer_store import AnswerStore, ask_once, ask_units_once
    from sentivote.session import shared_path

    def ask():
        def answer(batch):
            out = batch[[]].copy()
            out["raw"], out["tok_in"], out["tok_out"], out["duration_s"], out["erreur"] = batch["prompt"] + batch["model"], 1, 1, 0.0, None
            return out

        return answer

    units = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "a", None, "", "c"])], "id int, phrase string")
    prompt = F.concat(F.lit("p "), F.coalesce(F.upper("phrase"), F.lit("A")), "question_key")
    args = {"questions": ["q", "r"], "models": ["m", "n"]}
    plain, store = AnswerStore(shared_path(spark, "answers")), AnswerStore(shared_path(spark, "answers"))
    for some in (units.where("id < 2"), units):
        got = ask_units_once(some, prompt, "s", store, ask, **args)
        want = ask_once(calls.with_prompts(calls.call_plan(some, ["q", "r"], ["m", "n"]), prompt, "s"), plain, ask).select(*got.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # texts of one prompt are asked once
    assert store.replies(spark).count() == spark.read.parquet(store.path).count() == plain.replies(spark).count() == 16
    assert not {"phrase", "prompt", "system"} & set(got.columns)
