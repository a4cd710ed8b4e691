"""Learnt sentence boundaries with more words than become literals."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sentivote.functions import text as T
from sentivote.operators import boundaries, segment

DOCS = "source_folder string, source_file string, text string"
LONG = "viele lange Worte stehen hier in einer Reihe, damit kein Satz mit dem davor verbunden wird,"
TEXTS = [
    f"Es kam, {LONG} Dr. Weber, {LONG} am 3. Oktober. Er ging.",
    f"Es kam, {LONG} Dr. Weber, {LONG} am\t4. Oktober, {LONG} und Dr. Der Rest folgt.",
    f"# Teil, {LONG} 2. Oktober\n- Punkt, {LONG} 1. Oktober\nNach {LONG} (vgl. Dr. Klein) {LONG} am 5. April, {LONG} am 7. des Monats.\n\nNeu: {LONG} am 8. Mai.",
    f"Es war, {LONG} 12. „Oktober“ und, {LONG} „Dr.“ Weber, {LONG} 12. Nie.",
    "", ".", "Dr.", "3. Oktober", "12. Der", None,
]
LEARNT = [("abbreviation", "dr"), ("abbreviation", "vgl"), ("starter", "der"), ("ordinal", "oktober"), ("ordinal", "april"), ("ordinal", "nie")]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    named = [(f"f{i % 2}", f"{i}.md", t) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*named, named[0], (None, None, TEXTS[1])], DOCS)


@pytest.mark.parametrize("most", (0, 1, 2, 3, 20))
def test_words_that_documents_ask_for_cut_as_literals_do(spark, docs, most):
    learnt = spark.createDataFrame(LEARNT, "kind string, word string")
    by_literals = segment.phrases_flat(docs, boundaries.splitter(boundaries.read_boundaries(learnt)))
    found = segment.phrases_flat(*boundaries.with_learned(docs, learnt, most))
    assert found.columns == by_literals.columns
    assert rows(found) == rows(by_literals) != rows(segment.phrases_flat(docs))


def test_nothing_learnt_and_all_kinds_asked_for(spark, docs):
    learnt = spark.createDataFrame([], "kind string, word string")
    nothing = segment.phrases_flat(docs, boundaries.splitter(boundaries.Boundaries()))
    assert rows(segment.phrases_flat(*boundaries.with_learned(docs, learnt))) == rows(nothing)


def test_a_corpus_with_more_words_than_literals_is_cut_by_all_of_them(spark):
    n = boundaries.MOST_WORDS + 100
    said = F.concat(F.lit("Am 3. Wa"), F.col("id").cast("string"), F.lit(" kam heim er heim. "))
    docs = spark.range(n).select(F.lit("f").alias("source_folder"), F.col("id").cast("string").alias("source_file"), F.repeat(said, 4).alias("text"))
    with pytest.raises(ValueError, match="more than"):
        boundaries.read_boundaries(boundaries.learn(docs))
    known, cut = boundaries.learned_splitter(docs, docs)
    sizes = known.select(F.size(cut(F.col("text"))).alias("n")).groupBy("n").count().collect()
    assert [tuple(r) for r in sizes] == [(4, n)]


def test_words_are_cut_at_all_white_space(one):
    for text in ("a b", " a  b. ", "a b c　d", "\ta\nb\x1fc ", " x", "", " ", "é­ü ñ", "a\U0001f600 b", "1 2"):
        plain = one(lambda c: F.filter(F.split(c, f"{T.WS}+"), lambda t: t != ""), t=text)
        assert one(boundaries.written_words, t=text) == plain


def test_types_of_words(one):
    for word, kind in (("3", "#"), ("3.", "#"), ("1.000,5", "#"), ("3a", "3a"), ("Dr.", "dr"), ("z.B.", "z.b"), ("...", ".."), (".", ""), ("", ""), ("É.", "é"), ("٣.", "٣")):
        assert one(boundaries.word_type, w=word) == kind
