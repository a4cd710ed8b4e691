"""Properties that matter on a cluster: exchanges, hot groups, executor loss."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from sentivote import vocab
from sentivote.functions.ranking import numbered
from sentivote.operators import ballots as B
from sentivote.operators import clean, ensemble, segment, sensitivity, vote
from sentivote.plans import fixtures as fx
from sentivote.session import checkpointed

M = [m.name for m in vocab.MODELS]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    return len(re.findall(r"\bExchange (?:hash|range|single|RoundRobin)", plan(df)))


@pytest.fixture
def docs(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([("f", "a.md", "# T\nx")], "source_folder string, source_file string, text string").write.parquet(path)
    return spark.read.parquet(path)


def test_text_work_is_a_map(docs):
    cleaned = clean.clean_documents(docs).select("source_folder", "source_file", "text")
    for df in (
        cleaned, segment.tokens(cleaned), segment.phrases_flat(cleaned), segment.paragraphs(cleaned),
        segment.scored_units(segment.paragraphs(cleaned)), segment.simple_segments(cleaned),
    ):
        assert exchanges(df) == 0
        assert "Python" not in plan(df)


@pytest.fixture
def calls(spark, sf, tmp_path):
    path = str(tmp_path / "calls")
    fx.votes(spark, sf).write.parquet(path)
    return spark.read.parquet(path)


def test_votes_take_one_exchange(calls):
    assert exchanges(vote.classify(calls)) == 1
    assert exchanges(vote.per_question(vote.tally(calls))) == 1
    pairs = ensemble.pairs(B.ballots(calls, M), M, {"ref": M[:3], "alt": M[:2]}, "ref")
    assert exchanges(ensemble.unstable_segments(pairs, ensembles={"ref": M[:3], "alt": M[:2]}, reference="ref")) == 1
    assert exchanges(ensemble.stable_segments(pairs)) == 1
    assert "Join" not in plan(ensemble.divergent_segments(pairs))


def test_a_tally_aggregates_in_hash_maps(calls):
    text = plan(vote.classify(calls))
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text and text.count("HashAggregate") >= 2


def test_only_needed_columns_are_read(calls):
    scan = re.search(r"ReadSchema: (\S+)", plan(vote.per_question(vote.tally(calls.drop("tok_in", "tok_out", "duration_s")))))
    assert scan and "tok_in" not in scan[1] and "duration_s" not in scan[1]


def test_leave_k_out_takes_one_exchange(spark, sf, tmp_path):
    path = str(tmp_path / "pred")
    fx.predictions(spark, sf).write.parquet(path)
    folded = sensitivity.fold(spark.read.parquet(path), M)
    subsets = sensitivity.leave_k_out(folded, M)
    assert exchanges(subsets) == 1
    assert exchanges(sensitivity.stability(sensitivity.change_rates(subsets))) == 1
    assert exchanges(sensitivity.with_stability(folded, M)) == 1


def test_row_numbers_of_a_hot_group(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).otherwise("hot").alias("g"),
        F.format_string("f%05d", (F.col("id") * 7919) % 5003).alias("o"),
    )
    got = numbered(rows, ["o"], "pos", ["g"])
    by_group: dict[str, list] = {}
    for r in got.collect():
        by_group.setdefault(r["g"], []).append((r["o"], r["pos"]))
    for members in by_group.values():
        assert [p for _, p in sorted(members)] == list(range(len(members)))
    assert sum(map(len, by_group.values())) == 5000


def test_row_numbers_without_group_and_empty(spark):
    df = spark.range(100).select((99 - F.col("id")).alias("v"))
    assert all(r["v"] == r["pos"] for r in numbered(df, ["v"], "pos").collect())
    assert numbered(df.limit(0), ["v"], "pos").count() == 0


def test_checkpoint_uses_the_named_folder(spark, tmp_path):
    context = spark.sparkContext
    context.setCheckpointDir(str(tmp_path / "named"))
    df = checkpointed(spark.range(10))
    assert df.count() == 10
    assert any((tmp_path / "named").rglob("part-*"))
