"""The pipeline's stages, each on what the one before it kept."""

from __future__ import annotations

import random
import sys
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402

from sentivote.llm import cross_parse, importance, personal  # noqa: E402
from test_near import brute_near  # noqa: E402


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [("start", docs.columns, docs.collect())]
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, docs, sf)
        out.append((name, df.columns, df.collect()))
        if name != corpus_pipeline.STAGES[-1][0]:
            docs = spark.createDataFrame(out[-1][2], docs.schema)
    return out


def test_columns_stay(steps):
    for name, columns, _ in steps[1:-1]:
        assert columns == steps[0][1], name


def test_quality_keeps_labelled_documents(steps, spark, sf):
    kept = {r["doc_id"] for r in steps[1][2]}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    right = [(r["doc_id"] in kept) == (r["quality"] > 0) for r in labels]
    assert sum(right) / len(right) >= 0.9  # 87 labels; held-out accuracy is measured on larger tables


def test_language_keeps_what_has_letters(steps):
    before, after = ({r["doc_id"] for r in steps[k][2] if any(c.isalpha() for c in r["text"])} for k in (1, 2))
    assert before == after == {r["doc_id"] for r in steps[2][2]}


def test_one_document_of_each_group_stays(steps):
    texts = {r["doc_id"]: r["text"] for r in steps[2][2]}
    _, groups = brute_near(texts)
    assert {r["doc_id"] for r in steps[3][2]} == set(groups.values())


def test_personal_data_goes_and_the_rest_stays(steps):
    machine = personal.anchors()
    before = {r["doc_id"]: r["text"] for r in steps[3][2]}
    for r in steps[4][2]:
        assert not personal.find_spans(r["text"], machine) and r["n_chars"] == len(r["text"])
        if not personal.find_spans(before[r["doc_id"]], machine):
            assert r["text"] == before[r["doc_id"]]


def test_all_bytes_are_packed(steps):
    packed = {}
    for r in steps[5][2]:
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["n_tokens"]
    assert packed == {r["doc_id"]: len(r["text"].encode()) for r in steps[4][2] if r["text"]}


def test_run_gives_the_last_stage(spark, sf, steps):
    got = corpus_pipeline.run(spark, sf).agg(F.sum("n_tokens")).first()[0]
    assert got == sum(r["n_tokens"] for r in steps[-1][2])


def test_stages_on_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_parting_weight(spark):
    keys = spark.createDataFrame([(i, float(i), 0.0) for i in range(10)], "id long, w double, key double")
    label = spark.createDataFrame([(i, float(i > 5)) for i in range(10)], "id long, label double")
    assert importance.parting_weight(keys, label) == 5.5


def test_language_drops_texts_of_no_language_and_keeps_clean_ones(spark, sf):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9)))
    noise = [" ".join(word() for _ in range(n)) for n in (40, 400)] + ["".join(rng.choices("ABCDEFGHabcdefgh0123456789+/", k=3000)), "1 2 3"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    ids = [i for i in range(10**6, 10**6 + 100) if zlib.crc32(str(i).encode()) % 4 == 2]  # held out
    both = max((t for t in texts.values()), key=len)[:2000]
    rows = [*zip(ids, noise), (ids[8], "Ok."), (ids[9], both)]
    extra = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in cross_parse.kept_documents(docs.unionByName(extra, allowMissingColumns=True)).collect()}
    assert kept == {i for i, t in texts.items() if any(c.isalpha() for c in t)} | {ids[8], ids[9]}


def test_language_keeps_documents_when_none_was_learnt(spark, docs_of):
    docs = docs_of([(1, "clean text"), (2, "12 34"), (3, None), (4, "чистый текст")]).withColumn("lang", F.lit(None).cast("string"))
    kept = cross_parse.kept_documents(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 4]
