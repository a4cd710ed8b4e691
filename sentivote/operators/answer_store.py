"""Answers kept by what was asked: equal calls are asked once, over documents and over runs.

A call is its system message, its prompt and its model.  The digest of the three is the
key of a store of replies.  Calls are reduced to their distinct digests, those that the store
holds are left out, the provider gets the rest, and a join on the digest gives every call
its reply.  A phrase that ten thousand documents share costs one call per question and model.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentivote import vocab
from sentivote.operators.calls import RAW_SCHEMA, Ask, ask_external, with_prompts
from sentivote.session import checkpointed

#: What a call is.
MESSAGES = ("system", "prompt", "model")


def call_digest(system: Column, prompt: Column, model: Column) -> Column:
    """A digest that differs wherever one of the three does; null is told from empty."""
    return _digest(system, prompt_digest(prompt), model)


def prompt_digest(prompt: Column) -> Column:
    """What ``call_digest`` takes of the prompt: models that are asked the same can share it."""
    return F.coalesce(F.sha2(prompt, 256), F.lit("-"))


def _digest(system: Column, of_prompt: Column, model: Column) -> Column:
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.unhex(F.sha2(F.concat(part(system), part(model), of_prompt), 256))


class AnswerStore:
    """A folder of Parquet files (digest, reply).  Files are only added, so runs can share it.

    Two runs that ask the same at one time both add their reply; one of them is read, the same each time.
    """

    SCHEMA = f"digest binary, {RAW_SCHEMA}"

    def __init__(self, path: str):
        self.path = path

    def replies(self, spark: SparkSession) -> DataFrame:
        """One reply per digest; none before the first ``add``."""
        try:
            rows = spark.read.schema(self.SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], self.SCHEMA)
        names = [c for c in rows.columns if c != "digest"]
        return rows.groupBy("digest").agg(F.min(F.struct(*names)).alias("r")).select("digest", *[f"r.{c}" for c in names])

    def add(self, replies: DataFrame) -> None:
        """Add replies; a failed write leaves no part of them."""
        replies.select(*[c.split()[0] for c in self.SCHEMA.split(", ")]).write.mode("append").parquet(self.path)


def ask_once(calls: DataFrame, store: AnswerStore, ask: Callable[[], Ask]) -> DataFrame:
    """``calls`` with their replies and ``reused``: whether the store had the reply before.

    ``calls`` carries the messages, see ``calls.with_prompts``.  Only digest, messages and model of calls that were
    never asked go to Python, and only digest and reply come back.  Calls that fail keep
    their error in this result, on every call with that digest, and are asked again in
    the next run.  Tokens and durations are those of the reply, on every call that it answers.
    """
    keyed = calls.withColumn("digest", call_digest(*[F.col(c) for c in MESSAGES]))
    distinct = keyed.groupBy("digest").agg(F.first(F.struct(*MESSAGES)).alias("call")).select("digest", "call.*")
    # the store's files as they are now: those added below aren't among them
    before = store.replies(calls.sparkSession)
    new = distinct.join(before.select("digest"), "digest", "left_anti")
    return _answered(keyed, new, before, store, ask)


def ask_units_once(
    units: DataFrame, prompt: Column, system: str, store: AnswerStore, ask: Callable[[], Ask], text: str = "phrase",
    questions: Sequence[str] = tuple(vocab.QUESTION_KEYS), models: Sequence[str] = tuple(m.name for m in vocab.MODELS),
) -> DataFrame:
    """``ask_once`` over ``call_plan`` of ``units``, without the messages in the result.

    ``prompt`` is made of ``text`` and ``question_key``, and read for its digest once for all models.  A text is moved once and not once for each of its calls:
    different texts are written with a number, the digests find the calls that are new, and these are made where their text is.
    """
    def planned(rows: DataFrame) -> DataFrame:
        each = lambda names: F.explode(F.array(*[F.lit(n) for n in names]))
        asked = with_prompts(rows.select("*", each(questions).alias("question_key")), prompt, system)
        calls = asked.withColumn("_prompt", prompt_digest(F.col("prompt"))).select("*", each(models).alias("model"))
        return calls.withColumn("digest", _digest(F.col("system"), F.col("_prompt"), F.col("model"))).drop("_prompt")

    call = F.struct("question_key", "model")
    texts = checkpointed(units.select(text).distinct().withColumn("_of", F.monotonically_increasing_id()))
    before = store.replies(units.sparkSession)
    unknown = planned(texts).select("digest", "_of", call.alias("_call")).join(before.select("digest"), "digest", "left_anti")
    first = unknown.groupBy("digest").agg(F.min(F.struct("_of", "_call")).alias("f"))
    wanted = first.groupBy(F.col("f._of").alias("_of")).agg(F.collect_list("f._call").alias("_wanted"))
    new = planned(texts.join(wanted, "_of")).where(F.array_contains("_wanted", call))
    return _answered(planned(units).drop("system", "prompt", text), new.select("digest", *MESSAGES), before, store, ask)


def _answered(keyed: DataFrame, new: DataFrame, before: DataFrame, store: AnswerStore, ask: Callable[[], Ask]) -> DataFrame:
    """Asks the new calls, adds their replies to the store, and gives every call its reply."""
    # written, so that nothing is asked twice
    replies = checkpointed(ask_external(new, ask, keep=["digest"]))
    store.add(replies.where(F.col("erreur").isNull()))
    known = before.withColumn("reused", F.lit(True)).unionByName(replies.withColumn("reused", F.lit(False)))
    return keyed.join(known, "digest").drop("digest")
