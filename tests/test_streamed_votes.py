"""Votes kept as state while calls arrive, against the vote over all calls at once."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from sentivote import vocab
from sentivote.operators import vote
from sentivote.streaming import votes

SCHEMA = (
    "source_folder string, source_file string, phrase_index int, model string, question_key string, answer string, "
    "erreur string, tok_in int, tok_out int, duration_s double"
)
MODELS = [m.name for m in vocab.MODELS]


def some_calls(seed: int, units: int = 6) -> list[tuple]:
    rng, rows = random.Random(seed), []
    for u in range(units):
        for m in MODELS:
            for q in vocab.QUESTION_KEYS:
                if rng.random() < 0.7:
                    failed = rng.choice([None, None, "", "timeout"])
                    rows.append((None if u == 0 else "f", "a.md", u, m, q, rng.choice(["oui", "non", None]), failed, rng.randrange(99), 3, rng.random()))
    rows += rows[:5]  # calls that came twice
    rows += [("f", "a.md", 1, MODELS[0], "unlisted", "oui", None, 1, 1, 0.5), ("f", "b.md", 0, MODELS[0], "roi_1", "oui", None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture
def stream(spark, tmp_path):
    class Stream:
        def arrive(self, rows):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "calls"))

        def follow(self, **options):
            calls = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "calls"))
            return votes.follow(calls, str(tmp_path / "out"), str(tmp_path / "state"), **options)

        def tallies(self):
            return votes.tallies(spark, str(tmp_path / "out"))

    return Stream()


def same(df) -> list:
    return sorted((repr(sorted(r.asDict().items())) for r in df.collect()))


@pytest.mark.parametrize("seed, errors_as_no", [(1, False), (2, True)])
def test_any_order_gives_the_batch_result(spark, stream, seed, errors_as_no):
    rows = some_calls(seed)
    third = len(rows) // 3
    for part in (rows[:third], rows[third : 2 * third], rows[2 * third :]):
        stream.arrive(part)
    assert stream.follow(errors_as_no=errors_as_no) == 3
    whole = vote.tally(spark.createDataFrame(rows, SCHEMA), errors_as_no=errors_as_no)
    got = stream.tallies()
    assert set(got.columns) == set(whole.columns)
    assert same(got) == same(whole)
    assert same(vote.scored(got)) == same(vote.scored(whole))


def test_a_run_goes_on_from_the_checkpoint(spark, stream):
    rows = some_calls(3)
    stream.arrive(rows[:40])
    assert stream.follow() == 1
    assert same(stream.tallies()) == same(vote.tally(spark.createDataFrame(rows[:40], SCHEMA)))
    assert stream.follow() == 0
    stream.arrive(rows[40:])
    assert stream.follow() == 1
    assert same(stream.tallies()) == same(vote.tally(spark.createDataFrame(rows, SCHEMA)))


def test_a_batch_repeated_after_a_failure_doubles_nothing(spark, stream, tmp_path):
    rows = some_calls(4)
    stream.arrive(rows[:50])
    stream.arrive(rows[50:])
    done, broken = [], {"at": 1}
    running = lambda: votes.running_tallies(
        spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "calls"))
    )

    def fails_once(batch):
        done.append(1)
        if len(done) == 2 and broken.pop("at", None):
            batch.write.mode("append").parquet(str(tmp_path / "out" / "batch=1"))  # half a batch is there
            raise RuntimeError("lost")
        return batch

    with pytest.raises(Exception, match="lost"):
        votes.process_new(running(), fails_once, str(tmp_path / "out"), str(tmp_path / "state"), "update")
    assert votes.process_new(running(), fails_once, str(tmp_path / "out"), str(tmp_path / "state"), "update") == 1
    assert same(stream.tallies()) == same(vote.tally(spark.createDataFrame(rows, SCHEMA)))


def test_units_left_alone_leave_the_state_and_late_calls_still_count(spark, stream, tmp_path):
    rows = some_calls(5, units=3)
    early, late = rows[:30], rows[30:]
    stream.arrive(early)
    stream.follow(idle_ms=1)
    time.sleep(0.2)
    stream.arrive([("f", "other.md", 0, MODELS[0], "roi_1", "oui", None, 1, 1, 0.1)])
    stream.follow(idle_ms=1)  # the early units time out in this batch
    stream.arrive(late)
    stream.follow(idle_ms=1)
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.groupBy(*vocab.PHRASE_KEY).agg(F.count_distinct(votes.EPISODE).alias("n")).where("n > 1").count() > 0
    whole = vote.tally(spark.createDataFrame(rows + [("f", "other.md", 0, MODELS[0], "roi_1", "oui", None, 1, 1, 0.1)], SCHEMA))
    assert same(stream.tallies()) == same(whole)
