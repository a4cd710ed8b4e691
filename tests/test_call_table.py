"""Counted calls in buckets: the same reports as from the calls, without an exchange."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from sentivote import vocab
from sentivote.operators import ballots, ensemble, report, vote
from sentivote.operators.call_table import CallTable, counted
from sentivote.plans import fixtures as fx

M = [m.name for m in vocab.MODELS]
KEY = list(vocab.PHRASE_KEY)


def exchanges(df) -> int:
    return len(re.findall(r"\bExchange (?:hash|range|single|RoundRobin)", df._jdf.queryExecution().executedPlan().toString()))


def rows(df):
    return sorted(map(str, df.select(*[f"`{c}`" for c in sorted(df.columns)]).collect()))


@pytest.fixture(scope="module")
def calls(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("calls") / "calls")
    fx.votes(spark, sf).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def table(calls, tmp_path_factory):
    return CallTable.create(calls, str(tmp_path_factory.mktemp("table") / "it's"), buckets=5)


def test_reports_need_no_exchange(spark, table):
    few = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sets = {"ref": M[:3], "alt": M[:2]}
        pairs = ensemble.pairs(table.ballots(M), M, sets, "ref")
        for df in (table.tally(), vote.per_question(table.tally()), table.classify(), vote.answer_maps(table.classify()), table.wide(M), pairs):
            assert exchanges(df) == 0
        # two reports of a unit meet in its bucket
        assert exchanges(table.classify().select(*KEY, "categorie").join(table.wide(M).drop("categorie"), KEY)) == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", few)


def test_reports_are_those_of_the_calls(calls, table):
    assert rows(table.tally()) == rows(vote.tally(calls))
    assert rows(table.tally(errors_as_no=True)) == rows(vote.tally(calls, errors_as_no=True))
    assert rows(table.classify()) == rows(vote.classify(calls))
    assert rows(table.wide(M)) == rows(report.wide_phrases(calls, M))
    assert rows(table.ballots(M)) == rows(ballots.ballots(calls, M))


def test_another_session_reads_the_buckets(spark, calls, table):
    again = CallTable(spark.newSession(), table.path)
    assert (list(again.key), again.buckets) == (KEY, 5)
    assert exchanges(again.classify()) == 0
    assert rows(again.classify()) == rows(vote.classify(calls))


def test_later_calls_add_up_in_any_order(calls, tmp_path):
    late = F.col("question_key").startswith("obl")
    first, second = calls.where(~late), calls.where(late)
    for k, (a, b) in enumerate([(first, second), (second, first)]):
        grown = CallTable.create(a, str(tmp_path / f"t{k}"), buckets=3)
        grown.add(b)
        assert exchanges(grown.wide(M)) == 0
        assert rows(grown.tally()) == rows(vote.tally(calls))
        assert rows(grown.wide(M)) == rows(report.wide_phrases(calls, M))


def test_a_unit_asked_over_and_over_is_a_few_rows(spark, calls, tmp_path):
    one = calls.select(*KEY).limit(1).first()
    again = calls.where((F.col("source_file") == one["source_file"]) & (F.col("phrase_index") == one["phrase_index"]))
    many = calls.unionByName(again.select("*", F.explode(F.sequence(F.lit(1), F.lit(400)))).drop("col"))
    stored = CallTable.create(many, str(tmp_path / "hot"), buckets=4)
    per_unit = stored.rows().groupBy(*KEY).count().agg(F.max("count")).first()[0]
    assert per_unit <= len(M) * len(vocab.QUESTION_KEYS) < again.count() * 400
    assert rows(stored.tally()) == rows(vote.tally(many))
    # copies shrink before they are moved
    plan = counted(many)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"HashAggregate.*partial_count", plan)


def test_no_calls_and_null_keys(spark, calls, tmp_path):
    empty = CallTable.create(calls.limit(0), str(tmp_path / "none"), buckets=2)
    assert empty.tally().count() == empty.wide(M).count() == 0
    empty.add(calls)
    assert rows(empty.tally()) == rows(vote.tally(calls))
    lost = calls.withColumn("source_folder", F.lit(None).cast("string"))
    assert rows(CallTable.create(lost, str(tmp_path / "null"), buckets=2).tally()) == rows(vote.tally(lost))


def test_a_table_that_was_not_finished_is_refused(spark, calls, tmp_path):
    made = CallTable.create(calls.limit(5), str(tmp_path / "t"), buckets=2)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        CallTable(spark, made.path + "-other")
    with pytest.raises(Exception, match="(?i)exist"):
        CallTable.create(calls.limit(5), made.path, buckets=2)
