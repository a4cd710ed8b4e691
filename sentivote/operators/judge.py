"""A judge model's verdicts and the ground truth next to the first labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentivote import vocab
from sentivote.functions.numbers import percent
from sentivote.functions.ranking import numbered
from sentivote.functions.text import WS, strip
from sentivote.session import checkpointed

NO_TRUTH = "N/A"


def _index(df: DataFrame, column: str) -> Column:
    """Integer paragraph index; null where the cell holds no integer."""
    c = F.col(column)
    if dict(df.dtypes)[column] == "string":
        c = F.when(c.rlike(rf"^{WS}*[+-]?\d+{WS}*$"), strip(c))
    return c.try_cast("int")


def match_ground_truth(segments: DataFrame, truth: DataFrame) -> DataFrame:
    """Add ``categorie_gt``; segments without a truth row get ``N/A``.

    Truth rows match on trimmed file name and integer paragraph index, and on
    the folder when the truth has one.  Of several rows the last counts, by the
    ordinal column ``ord``.
    """
    on = [c for c in ("source_folder", "source_file", "paragraph_index") if c in truth.columns]
    rows = truth.select(
        *[c for c in on if c == "source_folder"],
        strip(F.col("source_file")).alias("source_file"),
        _index(truth, "paragraph_index").alias("paragraph_index"),
        strip(F.col("category")).alias("category"),
        "ord",
    ).filter(F.col("paragraph_index").isNotNull())
    last = rows.groupBy(*on).agg(F.max_by("category", "ord").alias("categorie_gt"))
    return segments.join(last, on, "left").withColumn("categorie_gt", F.coalesce("categorie_gt", F.lit(NO_TRUTH)))


def merge_verdicts(segments: DataFrame, verdicts: DataFrame, key: Sequence[str] = tuple(vocab.SEGMENT_KEY)) -> DataFrame:
    """Left-join verdicts with their defaults.

    Missing parts: the category is the first model's, confidence 0, texts
    empty, agreement false.
    """
    joined = segments.join(verdicts, list(key), "left")
    return joined.select(
        *segments.columns,
        F.coalesce("accord", F.lit(False)).alias("accord_avec_modele"),
        F.coalesce("categorie_juge", "categorie_cot").alias("categorie_juge"),
        F.coalesce("confiance_juge", F.lit(0.0)).alias("confiance_juge"),
        F.coalesce("justification_juge", F.lit("")).alias("justification_juge"),
        F.coalesce("analyse_critique", F.lit("")).alias("analyse_critique"),
    )


def accuracy(df: DataFrame, predicted: str, truth: str = "categorie_gt") -> DataFrame:
    """Percentage of right labels among the rows that have a truth; 0 without any."""
    counted = df.agg(
        F.count_if(F.col(truth) != NO_TRUTH).alias("n_gt"),
        F.count_if((F.col(truth) != NO_TRUTH) & (F.col(predicted) == F.col(truth))).alias("n_ok"),
    )
    return counted.withColumn("accuracy", percent(F.col("n_ok"), F.col("n_gt"), 1))


def judge_report(judged: DataFrame) -> DataFrame:
    """Totals, agreement, and both accuracies with their difference, in one row."""
    has_truth = F.col("categorie_gt") != NO_TRUTH
    counted = judged.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("accord_avec_modele").alias("n_accords"),
        F.count_if(has_truth).alias("n_gt"),
        F.count_if(has_truth & (F.col("categorie_cot") == F.col("categorie_gt"))).alias("ok_cot"),
        F.count_if(has_truth & (F.col("categorie_juge") == F.col("categorie_gt"))).alias("ok_juge"),
    )
    against = F.col("total") - F.col("n_accords")
    return counted.select(
        "total",
        "n_accords",
        against.alias("n_desaccords"),
        percent(F.col("n_accords"), F.col("total"), 1).alias("pct_accords"),
        percent(against, F.col("total"), 1).alias("pct_desaccords"),
        "n_gt",
        percent(F.col("ok_cot"), F.col("n_gt"), 1).alias("accuracy_cot"),
        percent(F.col("ok_juge"), F.col("n_gt"), 1).alias("accuracy_juge"),
    ).withColumn("delta_points", F.round(F.col("accuracy_juge") - F.col("accuracy_cot"), 1))


def self_consistency(segments: DataFrame, classified: DataFrame, key: Sequence[str] = tuple(vocab.SEGMENT_KEY)) -> DataFrame:
    """Stated label against the label that follows from the model's own answers."""
    own = classified.select(*key, F.col("categorie").alias("label_calcule"))
    return segments.join(own, list(key)).select(
        *key, "categorie_cot", "label_calcule", (F.col("categorie_cot") == F.col("label_calcule")).alias("coherent")
    )


def consistency_rate(checked: DataFrame) -> DataFrame:
    counted = checked.agg(F.count(F.lit(1)).alias("total"), F.count_if("coherent").alias("n_coherents"))
    return counted.withColumn("pct_coherents", percent(F.col("n_coherents"), F.col("total"), 1))


def judge_detail(judged: DataFrame, key: Sequence[str] = tuple(vocab.SEGMENT_KEY)) -> DataFrame:
    """Detail table with a corpus-wide row number and match marks."""
    rows = numbered(checkpointed(judged), list(key), "_pos")
    mark = lambda c: F.col(c) == F.col("categorie_gt")
    return rows.select(
        (F.col("_pos") + 1).alias("numero"),
        *key,
        F.col("section_title").alias("section"),
        F.col("paragraph").alias("extrait"),
        "categorie_cot",
        "confiance_cot",
        F.when(F.col("accord_avec_modele"), "OUI").otherwise("NON").alias("accord_juge"),
        "categorie_juge",
        "confiance_juge",
        "justification_juge",
        "analyse_critique",
        "categorie_gt",
        mark("categorie_cot").alias("cot_ok"),
        mark("categorie_juge").alias("juge_ok"),
    )
