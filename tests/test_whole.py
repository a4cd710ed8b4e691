"""Inputs are whole, nothing is lost on the way, and writes run their plan once."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sentivote.functions import paths
from sentivote.functions.ranking import numbered
from sentivote.operators import calls
from sentivote.plans import fixtures
from sentivote.sources import files


def test_markdown_inputs_hold_every_line_of_the_documents(spark, sf):
    docs = fixtures.table(spark, sf, "documents").select(F.format_string("doc_%d.md", "doc_id").alias("source_file"), F.col("text").alias("raw"))
    both = fixtures.md_docs(spark, sf).join(docs, "source_file")
    lost = F.exists(F.split("raw", "\n"), lambda line: ~F.contains("text", line))
    assert both.count() == docs.count() and both.where(lost).count() == 0


def test_blocks_hold_every_line_item(spark, sf):
    items = fixtures.table(spark, sf, "lineitem").count()
    assert fixtures.blocks(spark, sf).where("block_type = 'CELL'").count() == items


@pytest.mark.parametrize("name", ["plain", "with blank", "é+%", "a/../b"])
def test_paths_below_any_root(spark, tmp_path, name):
    root = tmp_path / name if ".." not in name else tmp_path / "a" / ".." / "b"
    (tmp_path / "a").mkdir(exist_ok=True)
    nested = root.resolve() / "c1" / str(root.resolve()).strip("/")
    nested.mkdir(parents=True)
    (root / "x.md").write_text("top")
    (nested / "x.md").write_text("deep")
    want = {(".", "x.md", "top"), (f"c1/{str(root.resolve()).strip('/')}", "x.md", "deep")}
    for given in (str(root), f"file://{root.resolve()}".replace(" ", "%20") if name == "plain" else str(root) + "/"):
        got = {(r["source_folder"], r["source_file"], r["text"]) for r in files.markdown_files(spark, given).collect()}
        assert got == want


def test_a_path_elsewhere_is_an_error(spark):
    df = spark.createDataFrame([("file:/other/x.md",)], "p string").select(paths.relative(F.col("p"), "file:/root"))
    with pytest.raises(Exception, match="not below"):
        df.collect()


def asked_of(spark, n):
    units = spark.createDataFrame([("c", "f", i, f"phrase {i}") for i in range(n)], "source_folder string, source_file string, phrase_index int, phrase string")
    return calls.call_plan(units, ["roi_1"], ["m"])


@pytest.fixture
def reply():
    def made(batch):  # a local function, so that it travels to the workers
        return pd.DataFrame({"raw": ['{"reponse": "oui"}'] * len(batch), "tok_in": 1, "tok_out": 1, "duration_s": 0.0, "erreur": None})

    return made


def test_one_bad_call_is_one_error_row(spark, reply):
    def ask():
        def answer(batch):
            if (batch["phrase"] == "phrase 7").any():
                raise RuntimeError("refused")
            return reply(batch)

        return answer

    rows = calls.read_answers(calls.ask_external(asked_of(spark, 20), ask)).collect()
    assert [r["phrase_index"] for r in rows if r["erreur"]] == [7]
    assert sum(r["answer"] == "oui" for r in rows) == 19


def test_a_reply_of_another_length_fails(spark, reply):
    with pytest.raises(Exception, match="a provider returned"):
        calls.ask_external(asked_of(spark, 3), lambda: lambda batch: reply(batch).head(1) if len(batch) > 1 else reply(batch).head(0)).collect()


def test_writing_asks_each_call_once_and_can_be_resumed(spark, tmp_path, reply):
    asked = spark.sparkContext.accumulator(0)

    def ask():
        def answer(batch):
            asked.add(len(batch))
            return reply(batch)

        return answer

    out = str(tmp_path / "out")
    replied = calls.ask_external(asked_of(spark, 20), ask)
    files.write_dataset(replied, out)
    assert asked.value == 20 and spark.read.parquet(out).count() == 20
    other = replied.withColumn("source_folder", F.lit("d"))
    files.write_dataset(other, out, mode="append")
    assert spark.read.parquet(out).groupBy("source_folder").count().count() == 2
    files.write_dataset(other.limit(5), out, mode="folders")
    assert {(r["source_folder"], r["count"]) for r in spark.read.parquet(out).groupBy("source_folder").count().collect()} == {("c", 20), ("d", 5)}


def test_row_numbers_keep_null_groups(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 5), (None, None)], "g string, v int")
    got = {(r["g"], r["v"], r["pos"]) for r in numbered(df, ["v"], "pos", group=["g"]).collect()}
    assert got == {("a", 1, 0), ("a", 2, 1), (None, None, 0), (None, 5, 1)}


def test_first_results_may_hold_maps(spark):
    df = spark.createDataFrame([("c", "f", 1, "b", {"x": 1}), ("c", "f", 1, "a", {"y": 2})], "source_folder string, source_file string, phrase_index int, source_path string, m map<string,int>")
    rows = calls.first_results(df, ["source_path"]).collect()
    assert [(r["source_path"], r["m"]) for r in rows] == [("a", {"y": 2})]
