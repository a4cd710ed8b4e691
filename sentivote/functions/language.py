"""Language of a text by counting function words, and routing to a splitter."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentivote.functions.text import let

# Function words that tell the four languages apart.
PROFILES: dict[str, list[str]] = {
    "fr": ["le", "les", "des", "une", "est", "dans", "pour", "qui", "sur", "avec", "du", "et", "au", "pas"],
    "en": ["the", "of", "and", "is", "that", "for", "with", "are", "this", "to", "it", "was", "be", "by"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "mit", "auf", "den", "von", "zu", "für", "im"],
    "es": ["el", "los", "las", "una", "por", "con", "para", "del", "y", "como", "su", "al", "lo", "se"],
}
LOADED = ("fr", "en")


def words_of(text: Column) -> Column:
    """The letter runs of a text, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), 0)


def detect(text: Column, profiles: Mapping[str, Sequence[str]] = PROFILES) -> Column:
    """Language with most function words, ties in profile order; null without any."""

    def best_of(words: Column) -> Column:
        scores = [
            F.struct(
                F.size(F.filter(words, lambda w: w.isin(list(known)))).alias("n"), F.lit(-i).alias("o"), F.lit(lang).alias("lang")
            )
            for i, (lang, known) in enumerate(profiles.items())
        ]
        return let(F.greatest(*scores), lambda best: F.when(best["n"] > 0, best["lang"]))

    return let(words_of(text), best_of)


def route(lang: Column, loaded: Sequence[str] = LOADED) -> Column:
    """The splitter's language: the detected one if loaded, else the first loaded."""
    return F.when(lang.isin(*loaded), lang).otherwise(loaded[0])


def routed(docs: DataFrame, profiles: Mapping[str, Sequence[str]] = PROFILES) -> DataFrame:
    """Add ``lang_detected`` and ``lang_routed``, whole texts, in the row."""
    return docs.withColumn("lang_detected", detect(F.col("text"), profiles)).withColumn(
        "lang_routed", route(F.col("lang_detected"))
    )
