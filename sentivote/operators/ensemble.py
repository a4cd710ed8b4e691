"""Ensemble substitution: does another set of models change the labels?

All ensembles are re-voted from one ballot row per unit.  The reference vote is
computed in the row and the alternatives are exploded next to it, so comparing
them takes no join and no exchange beyond the one that built the ballots.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentivote import vocab
from sentivote.functions.numbers import percent
from sentivote.operators.ballots import VALID, YES, mask_of, present
from sentivote.operators.vote import label

Ensembles = Mapping[str, Sequence[str]]

# Sentences of the reports.
STRONG = "Ce modèle influence fortement la classification — à garder en priorité"
MODERATE = "Ce modèle a un impact modéré"
WEAK = "Ce modèle est interchangeable sans impact majeur"
AMBIGUOUS = "Segment AMBIGU — catégorie réelle incertaine, révision manuelle conseillée"
SENSITIVE = ("Catégorie ", " robuste mais sensible au choix des modèles")
RELIABLE = "TRÈS HAUTE — stable dans tous les ensembles testés"


def _long(v: int) -> Column:
    return F.lit(v).cast("long")


def _voters(questions: Sequence[str]) -> Column:
    """Mask of the models with a valid prediction: any valid answer for the unit."""
    total = F.col(VALID + questions[0])
    for q in questions[1:]:
        total = total.bitwiseOR(F.col(VALID + q))
    return total


def _says_yes(q: str, mask: Column) -> Column:
    """More than half of the valid predictions; one that lacks the answer counts as "non"."""
    count = lambda c: F.bit_count(c.bitwiseAND(mask))
    return 2 * count(F.col(YES + q)) > count(F.col("voters"))


def _score(answers: Mapping[str, Column], prefix: str) -> Column:
    total = F.lit(0)
    for q, a in answers.items():
        if q.startswith(prefix + "_"):
            total = total + a.cast("int")
    return total


def _voted(df: DataFrame, mask: Column, side: str, questions: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Add answers, scores and label of one ensemble under the prefix ``side``."""
    answered = df.select(*keep, *[_says_yes(q, mask).alias(f"{side}a_{q}") for q in questions])
    answers = {q: F.col(f"{side}a_{q}") for q in questions}
    scored = answered.select(
        "*",
        _score(answers, "roi").alias(f"{side}roi"),
        _score(answers, "notoriete").alias(f"{side}not"),
        _score(answers, "obl").alias(f"{side}obl"),
    )
    return scored.withColumn(
        f"{side}categorie", label(F.col(f"{side}roi"), F.col(f"{side}not"), F.col(f"{side}obl"))
    )


def _effective(members: Column, everyone: Column) -> Column:
    """The ensemble, or every model when none of its members answered."""
    return F.when(members.bitwiseAND(everyone) == 0, everyone).otherwise(members)


def _listed(names: Sequence[str], ensembles: Ensembles, models: Sequence[str]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(i).alias("ens_no"), F.lit(n).alias("ensemble"), _long(mask_of(ensembles[n], models)).alias("mask"))
            for i, n in enumerate(names)
        ]
    )


def revote(
    ballots: DataFrame,
    models: Sequence[str],
    ensembles: Ensembles = vocab.ENSEMBLES,
    key: Sequence[str] = tuple(vocab.PHRASE_KEY),
    questions: Sequence[str] = tuple(vocab.QUESTION_KEYS),
) -> DataFrame:
    """One row per unit and ensemble: answers, scores, label, active models."""
    everyone = present(questions)
    rows = ballots.select("*", everyone.alias("everyone"), _voters(questions).alias("voters"), F.inline(_listed(list(ensembles), ensembles, models)))
    active = F.bit_count(F.col("mask").bitwiseAND(F.col("everyone"))).alias("n_modeles_actifs")
    rows = rows.select("*", active, _effective(F.col("mask"), F.col("everyone")).alias("eff"))
    return _voted(rows, F.col("eff"), "", questions, [*key, "ensemble", "n_modeles_actifs"])


def pairs(
    ballots: DataFrame,
    models: Sequence[str],
    ensembles: Ensembles = vocab.ENSEMBLES,
    reference: str = vocab.REFERENCE_ENSEMBLE,
    key: Sequence[str] = tuple(vocab.PHRASE_KEY),
    questions: Sequence[str] = tuple(vocab.QUESTION_KEYS),
) -> DataFrame:
    """One row per unit and alternative ensemble, next to the reference vote.

    Columns: key, ensemble, ref_*/alt_* label and scores, ``changed`` (questions
    whose answer differs, in question order), ``n_modeles_actifs``.
    """
    masks = [YES + q for q in questions] + ["voters"]
    base = ballots.withColumn("voters", _voters(questions)).select(*key, *masks, present(questions).alias("everyone"))
    ref_mask = _effective(_long(mask_of(ensembles[reference], models)), F.col("everyone"))
    with_ref = _voted(base.withColumn("ref_mask", ref_mask), F.col("ref_mask"), "ref_", questions,
                      [*key, *masks, "everyone"])
    names = [n for n in ensembles if n != reference]
    rows = with_ref.select("*", F.inline(_listed(names, ensembles, models)))
    active = F.bit_count(F.col("mask").bitwiseAND(F.col("everyone"))).alias("n_modeles_actifs")
    rows = rows.select("*", active, _effective(F.col("mask"), F.col("everyone")).alias("eff"))
    ref_columns = [f"ref_{c}" for c in ("categorie", "roi", "not", "obl")] + [f"ref_a_{q}" for q in questions]
    both = _voted(rows, F.col("eff"), "alt_", questions,
                  [*key, "ens_no", "ensemble", "n_modeles_actifs", *ref_columns])
    changed = F.filter(
        F.array(*[F.when(F.col(f"ref_a_{q}") != F.col(f"alt_a_{q}"), F.lit(q)) for q in questions]),
        lambda c: c.isNotNull(),
    )
    scores = [f"{s}_{c}" for s in ("ref", "alt") for c in ("categorie", "roi", "not", "obl")]
    return both.select(*key, "ens_no", "ensemble", "n_modeles_actifs", *scores, changed.alias("changed"))


def differs() -> Column:
    return F.col("ref_categorie") != F.col("alt_categorie")


def alternatives(df: DataFrame, ensembles: Ensembles = vocab.ENSEMBLES,
                 reference: str = vocab.REFERENCE_ENSEMBLE) -> DataFrame:
    """The alternative ensembles with the models they remove and add."""
    listed = lambda ms: F.array(*[F.lit(m) for m in ms]).cast("array<string>")
    ref = listed(ensembles[reference])
    rows = [
        F.struct(
            F.lit(n).alias("ensemble"),
            F.array_except(ref, listed(ms)).alias("modeles_retires"),
            F.array_except(listed(ms), ref).alias("modeles_ajoutes"),
        )
        for n, ms in ensembles.items()
        if n != reference
    ]
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))


def concordance(pairs_df: DataFrame, ensembles: Ensembles = vocab.ENSEMBLES,
                reference: str = vocab.REFERENCE_ENSEMBLE) -> DataFrame:
    """Per alternative: units, matching labels, percentage; zeros on an empty corpus."""
    counted = pairs_df.groupBy("ensemble").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~differs()).alias("c")
    )
    filled = alternatives(pairs_df, ensembles, reference).join(counted, "ensemble", "left")
    n, c = F.coalesce("n", F.lit(0)), F.coalesce("c", F.lit(0))
    return filled.select(
        "ensemble", "modeles_retires", "modeles_ajoutes", n.alias("n_segments"), c.alias("n_concordants")
    ).withColumn("taux_concordance", percent(F.col("n_concordants"), F.col("n_segments"), 2))


def concordance_by_class(pairs_df: DataFrame, categories: Sequence[str] = tuple(vocab.CATEGORIES)) -> DataFrame:
    """Per alternative and reference class; the percentage is null without such units."""
    aggs = []
    for i, c in enumerate(categories):
        of_class = F.col("ref_categorie") == c
        aggs += [F.count_if(of_class).alias(f"r{i}"), F.count_if(of_class & ~differs()).alias(f"c{i}")]
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("categorie"), F.col(f"r{i}").alias("n_ref"), F.col(f"c{i}").alias("n_concordants"))
            for i, c in enumerate(categories)
        ]
    )
    return (
        pairs_df.groupBy("ensemble")
        .agg(*aggs)
        .select("ensemble", F.inline(rows))
        .withColumn("taux", percent(F.col("n_concordants"), F.col("n_ref"), 1, None))
    )


def question_divergence(pairs_df: DataFrame, questions: Sequence[str] = tuple(vocab.QUESTION_KEYS)) -> DataFrame:
    """Per alternative and question: share of diverging units whose answer changed."""
    aggs = [F.count_if(differs()).alias("n_divergents")]
    aggs += [F.count_if(differs() & F.array_contains("changed", q)).alias(f"d_{q}") for q in questions]
    rows = F.array(*[F.struct(F.lit(q).alias("question_key"), F.col(f"d_{q}").alias("n_changes")) for q in questions])
    return (
        pairs_df.groupBy("ensemble")
        .agg(*aggs)
        .select("ensemble", "n_divergents", F.inline(rows))
        .withColumn("taux", percent(F.col("n_changes"), F.col("n_divergents"), 1))
    )


def _with_texts(units: DataFrame, texts: DataFrame | None, key: Sequence[str]) -> DataFrame:
    """Add the columns of ``texts`` (key and text) to what is left of the units."""
    return units if texts is None else units.join(texts, list(key), "left")


def divergent_segments(pairs_df: DataFrame, key: Sequence[str] = tuple(vocab.PHRASE_KEY),
                       texts: DataFrame | None = None) -> DataFrame:
    """Units whose label changes, with both score strings, the changed questions and, if given, the texts."""
    scores = lambda s: F.format_string("ROI:%d NOT:%d OBL:%d", f"{s}_roi", f"{s}_not", f"{s}_obl")
    rows = pairs_df.filter(differs()).select(
        *key,
        "ensemble",
        "ref_categorie",
        "alt_categorie",
        scores("ref").alias("ref_scores"),
        scores("alt").alias("alt_scores"),
        F.array_join("changed", " | ").alias("questions_changees"),
        "n_modeles_actifs",
    )
    return _with_texts(rows, texts, key)


def model_influence(concordance_df: DataFrame) -> DataFrame:
    """Effect of removing a model, over the alternatives that removed it."""
    removed = concordance_df.select(
        F.explode("modeles_retires").alias("model"),
        (100 - F.col("taux_concordance")).cast("decimal(9,2)").alias("divergence"),
    )
    stats = removed.groupBy("model").agg(
        F.count(F.lit(1)).alias("nb_comparaisons"),
        F.sum("divergence").alias("total"),
        F.max("divergence").alias("maximum"),
    )
    mean = F.col("total") / F.col("nb_comparaisons")
    return stats.select(
        "model",
        "nb_comparaisons",
        F.round(mean, 2).cast("double").alias("divergence_moy"),
        F.col("maximum").cast("double").alias("divergence_max"),
        F.when(mean > 15, "FORT").when(mean > 5, "MOYEN").otherwise("FAIBLE").alias("influence"),
        F.when(mean > 15, STRONG)
        .when(mean > 5, MODERATE)
        .otherwise(WEAK)
        .alias("interpretation"),
    ).orderBy(F.desc("divergence_moy"), "model")


def question_sensitivity(divergence_df: DataFrame) -> DataFrame:
    """Mean and maximum divergence of a question over all alternatives."""
    labels = F.create_map(*[c for k, v in vocab.QUESTION_LABELS.items() for c in (F.lit(k), F.lit(v))])
    stats = divergence_df.groupBy("question_key").agg(
        F.sum(F.col("taux").cast("decimal(9,1)")).alias("total"),
        F.count(F.lit(1)).alias("n"),
        F.max("taux").alias("maximum"),
    )
    mean = F.col("total") / F.col("n")
    return stats.select(
        "question_key",
        F.try_element_at(labels, F.col("question_key")).alias("label"),
        F.round(mean, 2).cast("double").alias("divergence_moy"),
        F.round("maximum", 2).alias("divergence_max"),
        F.when(mean > 30, "ÉLEVÉE").when(mean > 10, "MOYENNE").otherwise("FAIBLE").alias("sensibilite"),
    ).orderBy(F.desc("divergence_moy"), "question_key")


def _per_unit(pairs_df: DataFrame, key: Sequence[str], ensembles: Ensembles, reference: str) -> DataFrame:
    """Divergences of each unit in ensemble order; at most one entry per alternative."""
    ref = ensembles[reference]
    gone = F.create_map(
        *[
            c
            for n, ms in ensembles.items()
            for c in (F.lit(n), F.lit(" | ".join(m.split("/")[-1] for m in ref if m not in ms)))
        ]
    )
    entry = F.struct("ens_no", "ensemble", F.element_at(gone, F.col("ensemble")).alias("retires"), "alt_categorie")
    return pairs_df.groupBy(*key).agg(
        F.max("ref_categorie").alias("ref_categorie"),
        F.count_if(differs()).alias("n_changements"),
        F.sort_array(F.collect_list(F.when(differs(), entry))).alias("changes"),
    )


def unstable_segments(
    pairs_df: DataFrame,
    key: Sequence[str] = tuple(vocab.PHRASE_KEY),
    ensembles: Ensembles = vocab.ENSEMBLES,
    reference: str = vocab.REFERENCE_ENSEMBLE,
    texts: DataFrame | None = None,
) -> DataFrame:
    """Units that diverge in two alternatives or more, with a diagnosis."""
    joined = lambda f: F.array_join(F.transform("changes", lambda c: c[f]), " | ")
    seen = F.sort_array(F.array_distinct(F.transform("changes", lambda c: c["alt_categorie"])))
    rows = (
        _per_unit(pairs_df, key, ensembles, reference)
        .filter(F.col("n_changements") >= 2)
        .select(
            *key,
            "ref_categorie",
            "n_changements",
            F.array_join(seen, " | ").alias("categories_alt"),
            joined("ensemble").alias("ensembles_alt"),
            joined("retires").alias("modeles_retires"),
            F.when(F.size(seen) > 1, AMBIGUOUS)
            .otherwise(F.concat(F.lit(SENSITIVE[0]), "ref_categorie", F.lit(SENSITIVE[1])))
            .alias("diagnostic"),
        )
    )
    return _with_texts(rows, texts, key)


def stable_segments(pairs_df: DataFrame, key: Sequence[str] = tuple(vocab.PHRASE_KEY),
                    texts: DataFrame | None = None) -> DataFrame:
    """Units no alternative relabels, one row each."""
    rows = (
        pairs_df.groupBy(*key)
        .agg(F.max("ref_categorie").alias("categorie"), F.count_if(differs()).alias("n"))
        .filter("n = 0")
        .select(*key, "categorie", F.lit(RELIABLE).alias("fiabilite"))
    )
    return _with_texts(rows, texts, key)


def stability_headline(pairs_df: DataFrame, key: Sequence[str] = tuple(vocab.PHRASE_KEY)) -> DataFrame:
    """How many units keep their label under every alternative."""
    per_unit = pairs_df.groupBy(*key).agg(F.count_if(differs()).alias("n"))
    totals = per_unit.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("n") == 0).alias("n_stables"))
    changing = F.col("n_total") - F.col("n_stables")
    return totals.select(
        "n_total",
        "n_stables",
        changing.alias("n_changeants"),
        percent(F.col("n_stables"), F.col("n_total"), 1).alias("pct_stables"),
        percent(changing, F.col("n_total"), 1).alias("pct_changeants"),
    )


def global_view(pairs_df: DataFrame, ensembles: Ensembles = vocab.ENSEMBLES,
                reference: str = vocab.REFERENCE_ENSEMBLE,
                categories: Sequence[str] = tuple(vocab.CATEGORIES)) -> DataFrame:
    """One row per alternative: concordance overall and per class, models moved."""
    short = lambda c: F.array_join(F.transform(c, lambda m: F.element_at(F.split(m, "/"), -1)), " | ")
    per_class = (
        concordance_by_class(pairs_df, categories)
        .groupBy("ensemble")
        .agg(*[F.max(F.when(F.col("categorie") == c, F.col("taux"))).alias(f"concord_{c}") for c in categories])
    )
    return (
        concordance(pairs_df, ensembles, reference)
        .join(per_class, "ensemble", "left")
        .select(
            F.lit(reference).alias("ensemble_ref"),
            F.col("ensemble").alias("ensemble_alt"),
            short("modeles_retires").alias("modeles_retires"),
            short("modeles_ajoutes").alias("modeles_ajoutes"),
            "n_segments",
            "n_concordants",
            (F.col("n_segments") - F.col("n_concordants")).alias("n_divergents"),
            "taux_concordance",
            F.round(100 - F.col("taux_concordance"), 2).alias("taux_divergence"),
            *[f"concord_{c}" for c in categories],
        )
    )
