"""Vote, scores, label, agreement and cost over the recorded calls.

Calls are long: one row per unit, model and question.  ``tally`` folds them to
one row per unit with two counters per question.  The counters are sums, so the
map side already reduces a unit's calls to a single row before the one exchange
on the unit key; labels, agreement and every report are row arithmetic on top.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentivote import vocab
from sentivote.functions.money import cost_units, eur, usd
from sentivote.functions.numbers import percent, ratio, ticks

N, Y = "n_", "y_"  # counter prefixes: valid answers, and those saying yes


def is_valid(erreur: Column | None = None) -> Column:
    e = F.col("erreur") if erreur is None else erreur
    return e.isNull() | (e == "")


def tally(
    calls: DataFrame,
    key: Sequence[str] = tuple(vocab.PHRASE_KEY),
    questions: Sequence[str] = tuple(vocab.QUESTION_KEYS),
    errors_as_no: bool = False,
    also: Sequence[Column] = (),
) -> DataFrame:
    """One row per unit: counters per question, call count, errors, cost, time.

    ``errors_as_no`` counts a failed call as a valid "non" instead of leaving
    it out.  Token and duration columns are used when present; ``also`` takes
    more aggregates into the same pass.
    """
    valid = F.lit(True) if errors_as_no else is_valid()
    yes = is_valid() & (F.col("answer") == "oui")
    counters = []
    for q in questions:
        here = F.col("question_key") == q
        counters.append(F.count_if(here & valid).alias(N + q))
        counters.append(F.count_if(here & yes).alias(Y + q))
    extra = [
        F.count(F.lit(1)).alias("n_calls"),
        F.count_if(~is_valid()).alias("n_errors"),
    ]
    if {"tok_in", "tok_out"} <= set(calls.columns):
        extra.append(F.sum(cost_units()).alias("cost_units"))
    if "duration_s" in calls.columns:
        extra.append(F.sum(ticks(F.col("duration_s"), 4)).alias("duration_ticks"))
    return calls.groupBy(*key).agg(*counters, *extra, *also)


def majority(q: str) -> Column:
    """Strictly more than half of the valid answers; none valid or a tie is "non"."""
    return F.when(2 * F.col(Y + q) > F.col(N + q), "oui").otherwise("non")


def agreement(q: str) -> Column:
    """Share of the larger camp; 0.5 with fewer than two valid answers."""
    n, y = F.col(N + q), F.col(Y + q)
    return F.when(n < 2, 0.5).otherwise(F.greatest(y, n - y) / F.greatest(n, F.lit(1)))


def agreement_pct(q: str) -> Column:
    n, y = F.col(N + q), F.col(Y + q)
    return F.when(n < 2, 50.0).otherwise(percent(F.greatest(y, n - y), n, 1))


def per_question(tallied: DataFrame, key: Sequence[str] = tuple(vocab.PHRASE_KEY),
                 questions: Sequence[str] = tuple(vocab.QUESTION_KEYS)) -> DataFrame:
    """Long form of a tally: key, question, n_valid, n_oui, answer, agreement."""
    rows = F.array(
        *[
            F.struct(
                F.lit(q).alias("question_key"),
                F.col(N + q).alias("n_valid"),
                F.col(Y + q).alias("n_oui"),
                majority(q).alias("answer"),
                agreement(q).alias("agreement"),
            )
            for q in questions
        ]
    )
    return tallied.select(*key, F.inline(rows))


def score(questions: Sequence[str], prefix: str) -> Column:
    """Number of questions of a category answered "oui"."""
    hits = [F.when(2 * F.col(Y + q) > F.col(N + q), 1).otherwise(0) for q in questions if q.startswith(prefix + "_")]
    total = F.lit(0)
    for h in hits:
        total = total + h
    return total


def label(roi: Column, notoriete: Column, obligation: Column) -> Column:
    """Best score wins; ties go ROI, Obligation, Notoriete; all zero is Description."""
    best = F.greatest(roi, notoriete, obligation)
    return (
        F.when(best < 1, "Description").when(roi == best, "ROI").when(obligation == best, "Obligation").otherwise("Notoriete")
    )


def classify(
    calls: DataFrame,
    key: Sequence[str] = tuple(vocab.PHRASE_KEY),
    questions: Sequence[str] = tuple(vocab.QUESTION_KEYS),
    errors_as_no: bool = False,
    also: Sequence[Column] = (),
) -> DataFrame:
    """Tally plus scores, label, and rounded cost and duration per unit."""
    return scored(tally(calls, key, questions, errors_as_no, also), questions)


def scored(t: DataFrame, questions: Sequence[str] = tuple(vocab.QUESTION_KEYS)) -> DataFrame:
    """A tally with scores, label, and rounded cost and duration."""
    out = t.select(
        "*",
        score(questions, "roi").alias("scores_roi"),
        score(questions, "notoriete").alias("scores_notoriete"),
        score(questions, "obl").alias("scores_obligation"),
    ).withColumn("categorie", label(F.col("scores_roi"), F.col("scores_notoriete"), F.col("scores_obligation")))
    if "cost_units" in t.columns:
        out = out.withColumn("cost_usd_phrase", usd(F.col("cost_units"), 7)).withColumn(
            "cost_eur_phrase", eur(F.col("cost_units"), 7)
        )
    if "duration_ticks" in t.columns:
        out = out.withColumn("duration_s_phrase", ratio(F.col("duration_ticks"), F.lit(10_000), 2))
    return out


def answer_maps(classified: DataFrame, key: Sequence[str] = tuple(vocab.PHRASE_KEY),
                questions: Sequence[str] = tuple(vocab.QUESTION_KEYS)) -> DataFrame:
    """Answers and agreement as maps keyed by question."""
    names = F.array(*[F.lit(q) for q in questions])
    return classified.select(
        *key,
        "categorie",
        F.map_from_arrays(names, F.array(*[majority(q) for q in questions])).alias("reponses_questions"),
        F.map_from_arrays(names, F.array(*[agreement(q) for q in questions])).alias("agreement_rates"),
    )


def call_details(calls: DataFrame, key: Sequence[str] = tuple(vocab.PHRASE_KEY)) -> DataFrame:
    """Nested list of all calls of a unit, in model and question order; repeated calls stay."""
    from sentivote.functions.text import model_short

    detail = F.struct(
        "model",
        "question_key",
        model_short(F.col("model")).alias("model_short"),
        F.col("answer").alias("reponse"),
        "erreur",
        eur(cost_units(), 7).alias("cost_eur"),
        "duration_s",
    )
    return calls.groupBy(*key).agg(F.sort_array(F.collect_list(detail)).alias("detail_appels"))


def unanimity(tallied: DataFrame, questions: Sequence[str] = tuple(vocab.QUESTION_KEYS)) -> DataFrame:
    """Per question: units with two or more valid answers, and how many were unanimous."""
    sums = []
    for q in questions:
        n, y = F.col(N + q), F.col(Y + q)
        sums.append(F.count_if(n >= 2).alias("total_" + q))
        sums.append(F.count_if((n >= 2) & ((y == 0) | (y == n))).alias("agreed_" + q))
    rows = F.array(
        *[
            F.struct(
                F.lit(q).alias("question_key"),
                F.col("total_" + q).alias("n_comparaisons"),
                F.col("agreed_" + q).alias("n_unanimes"),
            )
            for q in questions
        ]
    )
    rate = F.when(F.col("n_comparaisons") == 0, 0.0).otherwise(
        F.col("n_unanimes") / F.greatest("n_comparaisons", F.lit(1))
    )
    return tallied.agg(*sums).select(F.inline(rows)).withColumn("taux", rate)
