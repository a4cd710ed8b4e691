"""Leave-k-out sensitivity of the confidence-weighted vote.

Predictions are folded to one row per segment with one category code and one
confidence per model.  Every subset of models is a number whose bits name its
members, exploded from a literal sequence, so the subsets are voted in the
row's own partition and the later groupings by segment need no exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentivote import vocab
from sentivote.functions.numbers import percent, ratio, rounded_mean, ticks
from sentivote.functions.text import quoted
from sentivote.operators.ballots import bit_of
from sentivote.operators.vote import is_valid

STABLE_FROM = 80.0
#: A segment has 2 ** n - 2 subsets; beyond this their ids leave an int.
MOST_SUBSET_MODELS = 30


def fold(predictions: DataFrame, models: Sequence[str], key: Sequence[str] = tuple(vocab.SEGMENT_KEY),
         categories: Sequence[str] = tuple(vocab.CATEGORIES)) -> DataFrame:
    """One row per segment, numbers only, so that the grouping runs on hash maps.

    ``mask_<n>`` holds the models that validly predicted category n, the first
    model in the highest bit; ``conf_<i>`` and ``cat_<i>`` what model i said.
    A model that isn't listed fails the job.
    """
    code = F.lit(None).cast("int")
    for n, c in enumerate(categories):
        code = F.when(F.col("categorie") == c, n).otherwise(code)
    aggs = [
        F.coalesce(F.bit_or(F.when(is_valid() & (F.col("_code") == n), F.col("_bit"))), F.lit(0)).cast("long").alias(f"mask_{n}")
        for n in range(len(categories))
    ]
    for i, m in enumerate(models):
        aggs.append(F.max(F.when(F.col("model") == m, F.col("_code"))).alias(f"cat_{i}"))
        aggs.append(F.max(F.when(F.col("model") == m, F.col("confiance"))).alias(f"conf_{i}"))
    return predictions.withColumns({"_code": code, "_bit": bit_of(models, first_highest=True)}).groupBy(*key).agg(*aggs)


def _voted(df: DataFrame, n_models: int, subset: Column, name: str,
           categories: Sequence[str] = tuple(vocab.CATEGORIES)) -> DataFrame:
    """Add ``name``: struct (best(s, f, c), whole), the vote by squared confidence.

    A category's voters are its mask cut to the subset.  Masks of different
    categories share no bit, so the larger one holds the earlier model: on equal
    sums it wins, as the category predicted first in model order must.
    """
    cut = df.select("*", *[F.col(f"mask_{n}").bitwiseAND(subset).alias(f"_m{n}") for n in range(len(categories))])
    sums = []
    for n in range(len(categories)):
        total = F.lit(0.0)
        for i in range(n_models):
            conf = F.coalesce(F.col(f"conf_{i}"), F.lit(0.0))
            total = total + F.getbit(F.col(f"_m{n}"), F.lit(n_models - 1 - i)).cast("double") * (conf * conf)
        sums.append(total.alias(f"_s{n}"))
    summed = cut.select("*", *sums)
    candidates, whole = [], F.lit(0.0)
    for n, c in enumerate(categories):
        voters, s = F.col(f"_m{n}"), F.col(f"_s{n}")
        candidates.append(F.when(voters != 0, F.struct(s.alias("s"), voters.alias("f"), F.lit(c).alias("c"))))
        whole = whole + s
    return summed.select(
        *quoted(df.columns), F.struct(F.greatest(*candidates).alias("best"), whole.alias("whole")).alias(name)
    )


def _label(v: Column) -> Column:
    return F.coalesce(v["best"]["c"], F.lit("Description"))


def _share(v: Column) -> Column:
    whole = F.coalesce(v["whole"], F.lit(0.0))
    return F.when(whole > 0, F.round(v["best"]["s"] / F.when(whole > 0, whole), 3)).otherwise(0.0)


def weighted_labels(folded: DataFrame, models: Sequence[str], key: Sequence[str] = tuple(vocab.SEGMENT_KEY)) -> DataFrame:
    """Vote of all models per segment: label and confidence (share, 3 digits)."""
    return _voted(folded, len(models), F.lit(2 ** len(models) - 1), "_v").select(
        *key, _label(F.col("_v")).alias("label"), _share(F.col("_v")).alias("confidence")
    )


def _subset_votes(folded: DataFrame, n: int) -> DataFrame:
    """Folded rows times subsets, with ``subset_id``, ``k``, ``label``, ``changed``."""
    if n > MOST_SUBSET_MODELS:
        raise ValueError(f"subsets of at most {MOST_SUBSET_MODELS} models can be listed, got {n}")
    # A single model has no proper subset.
    subsets = F.sequence(F.lit(1), F.lit(2**n - 2)) if n > 1 else F.array().cast("array<int>")
    with_ref = _voted(folded, n, F.lit(2**n - 1), "_all")
    exploded = with_ref.select("*", F.explode(subsets).alias("subset_id"))
    voted = _voted(exploded.withColumn("_ref", _label(F.col("_all"))).drop("_all"), n, F.col("subset_id"), "_v")
    return voted.withColumn("label", _label(F.col("_v"))).select(
        *folded.columns,
        "subset_id",
        (F.lit(n) - F.bit_count("subset_id")).alias("k"),
        "label",
        (F.col("label") != F.col("_ref")).alias("changed"),
    )


def with_stability(folded: DataFrame, models: Sequence[str]) -> DataFrame:
    """Add the stability score to the folded rows.

    The subsets are grouped back by the whole folded row, which is already
    partitioned by segment.
    """
    n = len(models)
    if n < 2:
        return folded.withColumn("stability_score", F.lit(100.0))
    counts = [
        a
        for k in range(1, n)
        for a in (
            F.count_if(F.col("k") == k).alias(f"_all_{k}"),
            F.count_if((F.col("k") == k) & F.col("changed")).alias(f"_changed_{k}"),
        )
    ]
    counted = _subset_votes(folded, n).groupBy(*folded.columns).agg(*counts)
    tenths = F.lit(0)
    for k in range(1, n):
        tenths = tenths + ticks(percent(F.col(f"_changed_{k}"), F.col(f"_all_{k}"), 1), 1)
    return counted.select(*folded.columns, _score(tenths, F.lit(n - 1)).alias("stability_score"))


def leave_k_out(folded: DataFrame, models: Sequence[str], key: Sequence[str] = tuple(vocab.SEGMENT_KEY)) -> DataFrame:
    """One row per segment and proper subset of the models.

    ``subset_id`` has model 0 in its highest bit; within one ``k`` (models
    removed) descending ids list the subsets in combination order.
    """
    return _subset_votes(folded, len(models)).select(*key, "subset_id", "k", "label", "changed")


def kept_names(models: Sequence[str]) -> Column:
    """Short names of a subset's models, sorted and joined."""
    n = len(models)
    named = sorted((m.split("/")[-1], i) for i, m in enumerate(models))
    return F.concat_ws(
        " + ", *[F.when(F.getbit(F.col("subset_id"), F.lit(n - 1 - i)) == 1, F.lit(s)) for s, i in named]
    )


def change_rates(subsets: DataFrame, key: Sequence[str] = tuple(vocab.SEGMENT_KEY)) -> DataFrame:
    """Per segment and number of removed models: subsets, changes, percentage."""
    counted = subsets.groupBy(*key, "k").agg(
        F.count(F.lit(1)).alias("nb_combinations"), F.count_if("changed").alias("nb_changes")
    )
    return counted.withColumn("pct_change", percent(F.col("nb_changes"), F.col("nb_combinations"), 1))


def _score(pct_tenths: Column, n: Column) -> Column:
    """100 minus the mean percentage; 100 when nothing was left out."""
    return ratio(1000 * n - pct_tenths, 10 * n, 1, default=100.0)


def stability(rates: DataFrame, key: Sequence[str] = tuple(vocab.SEGMENT_KEY)) -> DataFrame:
    """100 minus the plain mean of the rounded percentages over k."""
    totals = rates.groupBy(*key).agg(
        F.sum(ticks(F.col("pct_change"), 1)).alias("total"), F.count("pct_change").alias("n")
    )
    return totals.select(*key, _score(F.col("total"), F.col("n")).alias("stability_score"))


def stability_report(rates: DataFrame) -> DataFrame:
    """Per k: segments with at least one change, all segments, percentage."""
    counted = rates.groupBy("k").agg(
        F.count_if(F.col("nb_changes") > 0).alias("segments_affected"), F.count(F.lit(1)).alias("segments_total")
    )
    return counted.withColumn("pct_affected", percent(F.col("segments_affected"), F.col("segments_total"), 1))


def top_combinations(subsets: DataFrame, models: Sequence[str], top: int | None = None) -> DataFrame:
    """Per k the subsets by the labels they change, most first, ties in combination order; ``top`` of them, if given."""
    counted = subsets.groupBy("k", "subset_id").agg(
        F.count_if("changed").alias("nb_changes"), F.count(F.lit(1)).alias("total")
    )
    rated = counted.withColumn("pct_change", percent(F.col("nb_changes"), F.col("total"), 1))
    ranked = Window.partitionBy("k").orderBy(F.desc("pct_change"), F.desc("subset_id"))
    return (
        rated.withColumn("rank", F.row_number().over(ranked))
        .filter(F.lit(True) if top is None else F.col("rank") <= top)
        .select("k", "rank", kept_names(models).alias("models_kept"), "nb_changes", "total", "pct_change")
    )


def labelled_dataset(
    segments: DataFrame,
    folded: DataFrame,
    classified: DataFrame,
    models: Sequence[str],
    key: Sequence[str] = tuple(vocab.SEGMENT_KEY),
    questions: Sequence[str] = tuple(vocab.QUESTION_KEYS),
    categories: Sequence[str] = tuple(vocab.CATEGORIES),
) -> DataFrame:
    """The labelled dataset: text, label, confidence, stability, scores, details.

    ``segments`` carries the key, ``section_title`` and ``paragraph``;
    ``classified`` the tallied answers under the same key.
    """
    from sentivote.functions.paths import client, dossier
    from sentivote.operators.vote import majority

    names = F.array(*[F.lit(c) for c in categories])
    details = []
    for i, m in enumerate(models):
        short = m.split("/")[-1]
        details.append(F.get(names, F.col(f"cat_{i}")).alias(f"pred_{short}"))
        details.append(F.col(f"conf_{i}").alias(f"conf_{short}"))
    answers = classified.select(
        *key, "scores_roi", "scores_notoriete", "scores_obligation", *[majority(q).alias(f"Q_{q}") for q in questions]
    )
    stable = with_stability(folded, models)
    labelled = _voted(stable, len(models), F.lit(2 ** len(models) - 1), "_v").select(
        *key, _label(F.col("_v")).alias("label"), _share(F.col("_v")).alias("confidence"), "stability_score", *details
    )
    joined = segments.join(labelled, list(key)).join(answers, list(key), "left")
    return joined.select(
        client(F.col("source_folder")).alias("client"),
        dossier(F.col("source_folder")).alias("dossier"),
        *key,
        "section_title",
        "paragraph",
        "label",
        "confidence",
        "stability_score",
        "scores_roi",
        "scores_notoriete",
        "scores_obligation",
        *quoted([c for c in labelled.columns if c.startswith(("pred_", "conf_"))]),
        *[f"Q_{q}" for q in questions],
    )


def file_synthesis(dataset: DataFrame, file_key: Sequence[str] = tuple(vocab.FILE_KEY),
                   categories: Sequence[str] = tuple(vocab.CATEGORIES)) -> DataFrame:
    """Per file: segments per label, shares, mean confidence and stability."""
    counted = dataset.groupBy(*file_key).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("label") == c).alias(c) for c in categories],
        rounded_mean(F.col("confidence"), 3, 3).alias("conf_moy"),
        rounded_mean(F.col("stability_score"), 1, 1).alias("stabilite_moy"),
    )
    return counted.select("*", *[percent(F.col(c), F.col("total"), 1).alias(f"pct_{c}") for c in categories if c != "Description"])


def unstable(dataset: DataFrame, below: float = STABLE_FROM) -> DataFrame:
    return dataset.filter(F.col("stability_score") < below)
