"""Calls of a stream counted by micro-batch, without Python or state."""

from __future__ import annotations

from test_streamed_votes import MODELS, SCHEMA, same, some_calls, stream  # noqa: F401

from sentivote.operators import vote
from sentivote.streaming import votes


def test_batches_are_counted_without_state(spark, stream, tmp_path):  # noqa: F811
    rows = some_calls(7)
    late = ("f", "a.md", 1, MODELS[0], "roi_1", "oui", None, None, None, None)
    for part in (rows[:60], rows[60:], [late, late]):
        stream.arrive(part)
    assert stream.follow() == 3 and stream.follow() == 0
    assert not (tmp_path / "state" / "state").exists()  # no state store
    assert same(stream.tallies()) == same(vote.tally(spark.createDataFrame([*rows, late, late], SCHEMA)))
    assert spark.read.parquet(str(tmp_path / "out" / "batch=2")).select("n_calls").collect() == [(2,)]


def test_running_sums_are_still_there_on_demand(spark, stream, tmp_path):  # noqa: F811
    rows = some_calls(8)
    stream.arrive(rows[:60])
    stream.arrive(rows[60:])
    assert stream.follow(idle_ms=votes.IDLE_MS) == 2
    assert votes.EPISODE in spark.read.parquet(str(tmp_path / "out")).columns
    assert same(stream.tallies()) == same(vote.tally(spark.createDataFrame(rows, SCHEMA)))
