"""Counted calls stored by unit: votes, labels and wide reports read them without an exchange.

A report over recorded calls moves them to their units each time it is made.  A ``CallTable``
moves them once.  Calls of one unit, question and model become one row of sums, on the map side first, so a
unit that was asked again and again is a few rows before anything is moved.  These rows are dealt and
sorted by unit into as many buckets as the table was made with, and every grouping by the unit key reads
bucket by bucket.  Sums add up: later calls are appended and count as if they had been there from the start.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentivote import vocab
from sentivote.functions.money import cost_units
from sentivote.functions.numbers import ticks
from sentivote.operators.ballots import ASKED, BIT, VALID, YES, with_bit
from sentivote.operators.report import wide_rows
from sentivote.operators.vote import N, Y, is_valid, scored

KEY, QUESTIONS = tuple(vocab.PHRASE_KEY), tuple(vocab.QUESTION_KEYS)


def counted(calls: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """One row per unit, question and model: calls, valid ones, those saying yes, cost, time."""
    sums = [
        F.count(F.lit(1)).alias("n_calls"),
        F.count_if(is_valid()).alias("n_valid"),
        F.count_if(is_valid() & (F.col("answer") == "oui")).alias("n_yes"),
    ]
    if {"tok_in", "tok_out"} <= set(calls.columns):
        sums.append(F.sum(cost_units()).alias("cost_units"))
    if "duration_s" in calls.columns:
        sums.append(F.sum(ticks(F.col("duration_s"), 4)).alias("duration_ticks"))
    return calls.groupBy(*key, "question_key", "model").agg(*sums)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class CallTable:
    """Counted calls in buckets at a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        """Opens a table that ``create`` made, in this or an earlier session."""
        self.spark, self.path = spark, path.rstrip("/")
        # written last: a table without it isn't whole
        self.key, self.buckets, columns = spark.read.parquet(self.path + "-spec").select("key", "buckets", "columns").first()
        self.name = f"calls_{uuid.uuid4().hex}"
        by = ", ".join(map(quoted, self.key))
        place = self.path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {self.name} ({columns}) USING parquet "
            f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{place}'"
        )

    @classmethod
    def create(cls, calls: DataFrame, path: str, key: Sequence[str] = KEY, buckets: int | None = None) -> CallTable:
        """Stores ``calls``; ``buckets`` is the number of shuffle partitions unless given.

        Two exchanges: one of counted calls, one of units.  A table without calls is a table.
        """
        spark = calls.sparkSession
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = counted(calls, key)
        _write(rows, path.rstrip("/"), key, n, f"calls_{uuid.uuid4().hex}", "errorifexists")
        columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in rows.schema)
        spec = {"key": F.array(*[F.lit(k) for k in key]), "buckets": F.lit(n), "columns": F.lit(columns)}
        spark.range(1, numPartitions=1).select(*[c.alias(name) for name, c in spec.items()]).write.parquet(path.rstrip("/") + "-spec")
        return cls(spark, path)

    def add(self, calls: DataFrame) -> None:
        """Appends later calls: more files for the same buckets, read together with the earlier ones."""
        _write(counted(calls, self.key).select(*self.rows().columns), self.path, self.key, self.buckets, self.name, "append")
        self.spark.catalog.refreshTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def tally(self, questions: Sequence[str] = QUESTIONS, errors_as_no: bool = False, also: Sequence[Column] = ()) -> DataFrame:
        """As ``vote.tally`` over the calls."""
        return tally(self.rows(), self.key, questions, errors_as_no, also)

    def classify(self, questions: Sequence[str] = QUESTIONS, errors_as_no: bool = False) -> DataFrame:
        """As ``vote.classify`` over the calls."""
        return scored(self.tally(questions, errors_as_no), questions)

    def wide(self, models: Sequence[str], questions: Sequence[str] = QUESTIONS) -> DataFrame:
        """As ``report.wide_phrases`` over the calls."""
        masks = mask_aggregates(questions)
        folded = scored(tally(with_bit(self.rows(), models), self.key, questions, also=masks), questions)
        return wide_rows(folded, models, self.key, questions)

    def ballots(self, models: Sequence[str], questions: Sequence[str] = QUESTIONS) -> DataFrame:
        """As ``ballots.ballots`` over the calls: what the ensemble reports read."""
        return with_bit(self.rows(), models).groupBy(*self.key).agg(*mask_aggregates(questions))


def _write(rows: DataFrame, path: str, key: Sequence[str], buckets: int, name: str, mode: str) -> None:
    dealt = rows.repartition(buckets, *[F.col(quoted(k)) for k in key])
    dealt.write.mode(mode).bucketBy(buckets, *key).sortBy(*key).option("path", path).format("parquet").saveAsTable(name)


def tally(
    rows: DataFrame, key: Sequence[str] = KEY, questions: Sequence[str] = QUESTIONS, errors_as_no: bool = False, also: Sequence[Column] = (),
) -> DataFrame:
    """Counted calls to one row per unit, with the columns of ``vote.tally``."""
    total = lambda c, when=F.lit(True): F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0).cast("long"))
    valid = "n_calls" if errors_as_no else "n_valid"
    counters = []
    for q in questions:
        here = F.col("question_key") == q
        counters += [total(valid, here).alias(N + q), total("n_yes", here).alias(Y + q)]
    extra = [total("n_calls").alias("n_calls"), (total("n_calls") - total("n_valid")).alias("n_errors")]
    extra += [F.sum(c).alias(c) for c in ("cost_units", "duration_ticks") if c in rows.columns]
    return rows.groupBy(*key).agg(*counters, *extra, *also)


def mask_aggregates(questions: Sequence[str] = QUESTIONS) -> list[Column]:
    """The masks of ``ballots.mask_aggregates``, over counted calls."""
    masks = []
    for q in questions:
        here = F.col("question_key") == q
        for prefix, cond in ((ASKED, here), (VALID, here & (F.col("n_valid") > 0)), (YES, here & (F.col("n_yes") > 0))):
            masks.append(F.coalesce(F.bit_or(F.when(cond, F.col(BIT))), F.lit(0)).cast("long").alias(prefix + q))
    return masks
