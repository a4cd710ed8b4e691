"""Report tables over classified units and recorded calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentivote import vocab
from sentivote.functions.money import cost_units, eur, usd
from sentivote.operators.ballots import answer_bits, cost_columns, cost_of, mask_aggregates, model_answer_columns, with_bit
from sentivote.functions.numbers import exact_mean, exact_sum, percent, ratio, ticks
from sentivote.operators.vote import agreement_pct, classify, is_valid, majority

QUESTIONS = tuple(vocab.QUESTION_KEYS)
KEY = tuple(vocab.PHRASE_KEY)
FILE = tuple(vocab.FILE_KEY)
UNIT = (*FILE, "paragraph_index", "phrase_index")
PREFIX = {"ROI": "roi", "Notoriete": "notoriete", "Obligation": "obl"}


def _of(category: str, questions: Sequence[str]) -> list[str]:
    return [q for q in questions if q.startswith(PREFIX[category] + "_")]


def score_strings(questions: Sequence[str] = QUESTIONS) -> list[Column]:
    out = []
    for category, column in (("ROI", "scores_roi"), ("Notoriete", "scores_notoriete"), ("Obligation", "scores_obligation")):
        n = len(_of(category, questions))
        out.append(F.concat(F.col(column).cast("string"), F.lit(f"/{n}")).alias(f"{category}_Score"))
    return out


def phrase_columns(key: Sequence[str] = KEY, questions: Sequence[str] = QUESTIONS) -> list[Column]:
    return [
        *[F.col(k) for k in key],
        F.col("categorie"),
        *score_strings(questions),
        F.col("cost_eur_phrase"),
        F.col("duration_s_phrase"),
        *[agreement_pct(q).alias(f"ACCORD_{q}") for q in questions],
        *[majority(q).alias(f"AGG_{q}") for q in questions],
    ]


def phrase_rows(classified: DataFrame, key: Sequence[str] = KEY, questions: Sequence[str] = QUESTIONS) -> DataFrame:
    """One row per unit: label, score strings, cost, time, agreement, answers."""
    return classified.select(*phrase_columns(key, questions))


def wide_phrases(calls: DataFrame, models: Sequence[str], key: Sequence[str] = KEY,
                 questions: Sequence[str] = QUESTIONS) -> DataFrame:
    """``phrase_rows`` plus one column per model and question, from one pass."""
    return wide_rows(classify(with_bit(calls, models), key, questions, also=mask_aggregates(questions)), models, key, questions)


def wide_rows(folded: DataFrame, models: Sequence[str], key: Sequence[str] = KEY, questions: Sequence[str] = QUESTIONS) -> DataFrame:
    """The wide columns of labelled units that carry their models' masks."""
    return folded.select(*phrase_columns(key, questions), *model_answer_columns(models, questions))


def wide_units(calls: DataFrame, units: DataFrame, models: Sequence[str], key: Sequence[str] = UNIT,
               questions: Sequence[str] = QUESTIONS) -> DataFrame:
    """Report of paragraph mode: titles and phrases with section, text, label, costs, answers, and those of each model.

    ``units`` holds the key, ``section_title`` and ``phrase``; a title is the unit of phrase index -1.  The
    texts join last, so only keys and numbers are grouped.
    """
    errors = [F.max(F.when(F.col("model") == m, F.col("erreur"))).alias(f"_error_{i}") for i, m in enumerate(models)]
    folded = classify(with_bit(calls, models), key, questions, also=[*mask_aggregates(questions), *cost_columns(models), *errors])
    per_model = []
    for i, m in enumerate(models):
        short = m.split("/")[-1]
        per_model += [
            answer_bits(i, questions).alias(f"resp_{short}"),
            F.coalesce(f"_error_{i}", F.lit("")).alias(f"err_{short}"),
            cost_of(i).alias(f"cost_eur_{short}"),
        ]
    rows = folded.select(
        *key, (F.col("phrase_index") == -1).alias("is_title"), "categorie", *score_strings(questions), "cost_usd_phrase", "cost_eur_phrase",
        *[majority(q).alias(f"Q_{q}") for q in questions], *per_model,
    )
    return rows.join(units.select(*key, "section_title", "phrase"), list(key))


def flat_listing(classified: DataFrame, texts: DataFrame, key: Sequence[str] = KEY,
                 questions: Sequence[str] = QUESTIONS) -> DataFrame:
    """Global listing: text, label, score strings, cost, aggregated answers."""
    rows = classified.select(
        *key, "categorie", *score_strings(questions), F.col("cost_eur_phrase"),
        *[majority(q).alias(f"AGG_{q}") for q in questions],
    )
    return rows.join(texts, list(key))


def agreement_per_phrase(classified: DataFrame, texts: DataFrame, key: Sequence[str] = KEY,
                         questions: Sequence[str] = QUESTIONS) -> DataFrame:
    rows = classified.select(*key, *[agreement_pct(q).alias(f"Accord_{q}") for q in questions])
    short = texts.select(*key, F.col("phrase").alias("phrase_text"))
    return short.join(rows, list(key))


def file_summary(classified: DataFrame, file_key: Sequence[str] = FILE, questions: Sequence[str] = QUESTIONS) -> DataFrame:
    """Per file: label counts, cost, time, mean agreement.

    ``accord_q1_*`` averages the first question of a category only;
    ``accord_moyen_*`` averages all its questions.
    """
    aggs = [F.count(F.lit(1)).alias("total_phrases")]
    aggs += [F.count_if(F.col("categorie") == c).alias(c) for c in vocab.CATEGORIES]
    aggs += [
        exact_sum(F.col("cost_eur_phrase"), 7).alias("cout_total_eur"),
        exact_mean(F.col("cost_eur_phrase"), 7).alias("cout_moyen_eur"),
        exact_sum(F.col("duration_s_phrase"), 2).alias("duree_totale_s"),
        exact_mean(F.col("duration_s_phrase"), 2).alias("duree_moyenne_s"),
    ]
    for category in PREFIX:
        qs = _of(category, questions)
        if not qs:
            continue
        every = agreement_pct(qs[0])
        for q in qs[1:]:
            every = every + agreement_pct(q)
        aggs.append(exact_mean(agreement_pct(qs[0]), 1).alias(f"accord_q1_{category}"))
        aggs.append((exact_mean(every, 1) / len(qs)).alias(f"accord_moyen_{category}"))
    return classified.groupBy(*file_key).agg(*aggs)


def model_stats(calls: DataFrame, models: Sequence[str]) -> DataFrame:
    """Per model: tokens, cost, calls, errors; models without calls show zeros, unlisted ones are shown too."""
    listed = calls.sparkSession.range(1).select(F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    counted = calls.groupBy("model").agg(
        F.sum("tok_in").alias("i"),
        F.sum("tok_out").alias("o"),
        F.sum(cost_units()).alias("u"),
        F.count(F.lit(1)).alias("c"),
        F.count_if(~is_valid()).alias("e"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return listed.join(counted, "model", "full").select(
        "model",
        zero("i").alias("tokens_in"),
        zero("o").alias("tokens_out"),
        usd(zero("u"), 6).alias("cout_usd"),
        eur(zero("u"), 6).alias("cout_eur"),
        zero("c").alias("nb_appels"),
        zero("e").alias("nb_erreurs"),
        percent(zero("e"), zero("c"), 2).alias("taux_erreur"),
    )


def file_costs(calls: DataFrame, file_key: Sequence[str] = FILE) -> DataFrame:
    summed = calls.groupBy(*file_key).agg(F.sum(cost_units()).alias("u"))
    return summed.select(*file_key, usd(F.col("u"), 6).alias("cout_usd"), eur(F.col("u"), 6).alias("cout_eur"))


def question_agreement(unanimity_df: DataFrame) -> DataFrame:
    """Unanimity per question with its category and text."""
    look = lambda f: F.create_map(*[c for q in vocab.QUESTIONS for c in (F.lit(q.key), F.lit(f(q)))])
    q = F.col("question_key")
    return unanimity_df.select(
        "question_key",
        F.try_element_at(look(lambda x: x.category), q).alias("categorie"),
        F.try_element_at(look(lambda x: x.text), q).alias("texte"),
        percent(F.col("n_unanimes"), F.col("n_comparaisons"), 2).alias("taux_accord"),
        F.col("n_comparaisons").alias("nb_comparaisons"),
    )


def category_distribution(classified: DataFrame, column: str = "categorie",
                          categories: Sequence[str] = tuple(vocab.CATEGORIES)) -> DataFrame:
    """Units per category, every category listed."""
    counted = classified.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(column) == c).alias(f"c_{c}") for c in categories]
    )
    rows = F.array(*[F.struct(F.lit(c).alias("categorie"), F.col(f"c_{c}").alias("nombre")) for c in categories])
    return counted.select("n", F.inline(rows)).select(
        "categorie", "nombre", percent(F.col("nombre"), F.col("n"), 1).alias("pourcentage")
    )


def global_stats(classified: DataFrame, models: Sequence[str], questions: Sequence[str] = QUESTIONS) -> DataFrame:
    """One row of totals: units, cost, time, labels with their shares."""
    counted = classified.agg(
        F.count(F.lit(1)).alias("total_phrases"),
        F.coalesce(F.sum("cost_units"), F.lit(0)).alias("u"),
        F.coalesce(F.sum(ticks(F.col("duration_s_phrase"), 2)), F.lit(0)).alias("s"),
        *[F.count_if(F.col("categorie") == c).alias(f"total_{c}") for c in vocab.CATEGORIES],
    )
    n = F.col("total_phrases")
    return counted.select(
        "total_phrases",
        usd(F.col("u"), 6).alias("cout_total_usd"),
        eur(F.col("u"), 6).alias("cout_total_eur"),
        F.when(n == 0, 0.0).otherwise(eur(F.col("u"), 7, F.greatest(n, F.lit(1)))).alias("cout_phrase_eur"),
        ratio(F.col("s"), F.lit(6000), 2).alias("duree_min"),
        F.lit(vocab.USD_PER_EUR).alias("taux_eur_usd"),
        F.lit(len(models)).alias("nb_modeles"),
        F.lit(len(questions)).alias("nb_questions"),
        F.lit(" | ".join(m.split("/")[-1] for m in models)).alias("modeles"),
        *[F.col(f"total_{c}") for c in vocab.CATEGORIES],
        *[percent(F.col(f"total_{c}"), n, 1).alias(f"pct_{c}") for c in vocab.CATEGORIES],
    )
