"""What goes to Python and what comes back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from sentivote.llm import fill_middle, personal


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_of_fill_middle_digests_go_to_python_once_and_none_comes_back(spark):
    texts = ["a\nb\nc\n" * 9, "é\n😀", None, "", "has <S>\nx", "one line", "\n\n", "x" * 70_000 + "\ny"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a\nb"), (1, texts[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    got = fill_middle.digest(docs, rate=90)
    plan = plan_of(got)
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    out = fill_middle.transformed(docs, rate=90)
    whole = out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256), F.sha2(fill_middle.restored(out), 256)
    )
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, whole.collect())))


def test_masked_texts_leave_python_in_parts(spark):
    machine = personal.anchors()
    long = "write to a@b.org " + "x" * 1_000_000
    texts = [long if i % 2 else None for i in range(40)]
    parts = list(personal.masked_parts(pa.array(texts), machine))
    assert len(parts) >= 5 and max(p.nbytes for p in parts) < 2 * personal.MASKED_BYTES
    want = [personal.masked_text(t, machine) for t in texts]
    assert pa.concat_arrays(parts).to_pylist() == want
    assert list(personal.masked_parts(pa.array([], pa.string()), machine)) == []
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(1)
    got = {r["doc_id"]: r["text"] for r in personal.masked(docs).collect()}
    assert [got[i] for i in range(40)] == want
    assert personal.masked(docs.limit(0)).count() == 0
