"""One row per unit with three bit masks per question: asked, valid, yes.

Model number i of the given list owns bit i.  Masks combine with ``bit_or``,
so the map side reduces each unit to one row of integers; afterwards any set of
models can be re-voted by masking and counting bits, with no further exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentivote import vocab
from sentivote.functions.money import cost_units, eur
from sentivote.functions.ranking import numbered
from sentivote.operators.vote import is_valid
from sentivote.session import checkpointed

ASKED, VALID, YES, BIT = "asked_", "valid_", "yes_", "_bit"
MAX_MODELS = 62


def mask_of(members: Sequence[str], models: Sequence[str]) -> int:
    return sum(1 << models.index(m) for m in members if m in models)


def bit_of(models: Sequence[str], first_highest: bool = False) -> Column:
    """Bit of a row's model; a model that isn't listed fails the job by its name."""
    if len(models) > MAX_MODELS:
        raise ValueError(f"at most {MAX_MODELS} models fit into a mask, got {len(models)}")
    place = lambda i: len(models) - 1 - i if first_highest else i
    bits = F.create_map(*[c for i, m in enumerate(models) for c in (F.lit(m), F.lit(1 << place(i)).cast("long"))])
    unknown = F.raise_error(F.concat(F.lit("model is not listed: "), F.coalesce("model", F.lit("null")))).cast("long")
    return F.coalesce(F.try_element_at(bits, F.col("model")) if models else F.lit(None).cast("long"), unknown)


def with_bit(calls: DataFrame, models: Sequence[str]) -> DataFrame:
    """Add each call's bit once, ahead of the aggregates that read it."""
    return calls.withColumn(BIT, bit_of(models))


def mask_aggregates(questions: Sequence[str] = tuple(vocab.QUESTION_KEYS)) -> list[Column]:
    """The three masks per question, as aggregates over calls that went through ``with_bit``."""
    bit = F.col(BIT)
    masks = []
    for q in questions:
        here = F.col("question_key") == q
        for prefix, cond in (
            (ASKED, here),
            (VALID, here & is_valid()),
            (YES, here & is_valid() & (F.col("answer") == "oui")),
        ):
            masks.append(F.coalesce(F.bit_or(F.when(cond, bit)), F.lit(0)).cast("long").alias(prefix + q))
    return masks


def ballots(
    calls: DataFrame,
    models: Sequence[str],
    key: Sequence[str] = tuple(vocab.PHRASE_KEY),
    questions: Sequence[str] = tuple(vocab.QUESTION_KEYS),
    with_cost: bool = False,
) -> DataFrame:
    """Fold calls to masks, on request with the cost of each model."""
    costs = cost_columns(models) if with_cost else []
    return with_bit(calls, models).groupBy(*key).agg(*mask_aggregates(questions), *costs)


def present(questions: Sequence[str]) -> Column:
    """Mask of the models that gave any answer, failed or not."""
    total = F.col(ASKED + questions[0])
    for q in questions[1:]:
        total = total.bitwiseOR(F.col(ASKED + q))
    return total


def cell(question: str, i: int) -> Column:
    """Answer of model i to a question: oui, non, ERR (failed) or ? (not asked)."""
    has = lambda prefix: F.col(prefix + question).bitwiseAND(F.lit(1 << i).cast("long")) != 0
    return F.when(~has(ASKED), "?").when(~has(VALID), "ERR").when(has(YES), "oui").otherwise("non")


# --- answer tensor ---------------------------------------------------------------


def tensor_coo(
    ballots_df: DataFrame,
    models: Sequence[str],
    position: Sequence[str] = ("source_file", "phrase_index"),
    questions: Sequence[str] = tuple(vocab.QUESTION_KEYS),
) -> DataFrame:
    """Non-zero cells of the (client, phrase, model, question) tensor.

    Clients are numbered in name order, units inside a client by ``position``.
    The ballots are read several times for that, so they are written first.
    """
    ballots_df = checkpointed(ballots_df)
    placed = numbered(ballots_df, position, "phrase_pos", group=["source_folder"])
    clients = client_axis(ballots_df)
    positions = F.sequence(F.lit(0), F.lit(len(models) - 1))

    def hits_of(n: int, q: str) -> Column:
        voted = F.filter(positions, lambda i: F.getbit(F.col(YES + q), i) == 1)
        return F.transform(voted, lambda i: F.struct(i.alias("model_pos"), F.lit(n).alias("question_pos")))

    hits = F.flatten(F.array(*[hits_of(n, q) for n, q in enumerate(questions)]))
    return placed.join(clients, "source_folder").select(
        "client_pos", "phrase_pos", F.inline(hits), F.lit(1).cast("tinyint").alias("value")
    )


def client_axis(units: DataFrame) -> DataFrame:
    return numbered(units.select("source_folder").distinct(), ["source_folder"], "client_pos")


def model_axis(spark: SparkSession, models: Sequence[str]) -> DataFrame:
    """model_pos, model, short name."""
    rows = F.array(*[F.struct(F.lit(i).alias("model_pos"), F.lit(m).alias("model"), F.lit(m.split("/")[-1]).alias("short")) for i, m in enumerate(models)])
    return spark.range(1).select(F.inline(rows))


def question_axis(spark: SparkSession, questions: Sequence[vocab.Question] = tuple(vocab.QUESTIONS)) -> DataFrame:
    """question_pos, question_key, categorie, texte."""
    rows = F.array(*[
        F.struct(F.lit(i).alias("question_pos"), F.lit(q.key).alias("question_key"), F.lit(q.category).alias("categorie"), F.lit(q.text).alias("texte"))
        for i, q in enumerate(questions)
    ])
    return spark.range(1).select(F.inline(rows))


def phrase_axis(texts: DataFrame, position: Sequence[str] = ("source_file", "phrase_index")) -> DataFrame:
    """client_pos and phrase_pos of every row of ``texts``, as in ``tensor_coo`` over the same units, with its columns.

    Only the keys are numbered; the texts join their numbers last.
    """
    key = ["source_folder", *position]
    keys = checkpointed(texts.select(*key))
    placed = numbered(keys, position, "phrase_pos", group=["source_folder"]).join(client_axis(keys), "source_folder")
    return texts.join(placed, key)


def tensor_shape(ballots_df: DataFrame, models: Sequence[str],
                 questions: Sequence[str] = tuple(vocab.QUESTION_KEYS)) -> DataFrame:
    """Dimensions of the padded tensor, in one row."""
    sizes = ballots_df.groupBy("source_folder").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("n_clients"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_phrases_per_client"),
        F.lit(len(models)).alias("n_models"),
        F.lit(len(questions)).alias("n_questions"),
    )


# --- wide reports ------------------------------------------------------------------


def model_answer_columns(models: Sequence[str], questions: Sequence[str] = tuple(vocab.QUESTION_KEYS)) -> list[Column]:
    """One column per model and question, named ``<short model>__<question>``."""
    short = lambda m: m.split("/")[-1]
    return [cell(q, i).alias(f"{short(m)}__{q}") for i, m in enumerate(models) for q in questions]


def answer_bits(i: int, questions: Sequence[str] = tuple(vocab.QUESTION_KEYS)) -> Column:
    """Answers of model i as a string such as ``R:101 N:000 O:010``."""

    def bits(prefix: str) -> Column:
        return F.concat(
            *[F.getbit(F.col(YES + q), F.lit(i)).cast("string") for q in questions if q.startswith(prefix + "_")]
        )

    return F.concat(F.lit("R:"), bits("roi"), F.lit(" N:"), bits("notoriete"), F.lit(" O:"), bits("obl"))


def cost_columns(models: Sequence[str]) -> list[Column]:
    """The cost of each model, as aggregates."""
    return [F.sum(F.when(F.col("model") == m, cost_units())).alias(f"cost_units_{i}") for i, m in enumerate(models)]


def cost_of(i: int) -> Column:
    return F.coalesce(eur(F.col(f"cost_units_{i}"), 7), F.lit(0.0))


def compact_answers(ballots_df: DataFrame, models: Sequence[str],
                    key: Sequence[str] = tuple(vocab.PHRASE_KEY),
                    questions: Sequence[str] = tuple(vocab.QUESTION_KEYS)) -> DataFrame:
    """Per model a string such as ``R:101 N:000 O:010``, and its cost if folded in."""
    columns = []
    for i, m in enumerate(models):
        short = m.split("/")[-1]
        columns.append(answer_bits(i, questions).alias(f"resp_{short}"))
        if f"cost_units_{i}" in ballots_df.columns:
            columns.append(cost_of(i).alias(f"cost_eur_{short}"))
    return ballots_df.select(*key, *columns)
