from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sentivote.operators import clean, segment
from sentivote.plans import oracle_text as X

SCHEMA = "source_folder string, source_file string, text string"


def docs(spark, *texts):
    return spark.createDataFrame([("f", f"doc_{i}.md", t) for i, t in enumerate(texts)], SCHEMA)


def cleaned(spark, text):
    return clean.clean_documents(docs(spark, text)).first()


def test_clean_keeps_fences_and_drops_rules(spark):
    row = cleaned(spark, "a\n---\n```\n---\n<b>x</b>\n```\n![i](u)\n\n\n\nb")
    assert row["text"] == "a\n```\n---\n<b>x</b>\n```\n\nb"
    assert (row["n_before"], row["n_after"], row["bad"]) == (10, 6, False)


def test_unclosed_fence_protects_the_rest(spark):
    assert cleaned(spark, "a\n```\n<b>x</b>\n***")["text"] == "a\n```\n<b>x</b>\n***"


def test_text_starting_with_a_fence(spark):
    assert cleaned(spark, "```\n**c**\n```\n**d**")["text"] == "```\n**c**\n```\nd"


def test_null_and_empty_documents(spark):
    report = clean.clean_report(clean.clean_documents(docs(spark, None, "", "x\ny"))).first()
    assert tuple(report) == (2, 1, 1, 1)


def tokens_of(spark, text):
    return [(r["kind"], r["level"], r["text"]) for r in segment.tokens(docs(spark, text)).orderBy("tok_pos").collect()]


def test_separator_belongs_to_a_table_even_across_a_fence(spark):
    assert tokens_of(spark, "| a |\n:--\nx") == [("text", None, "x")]
    assert tokens_of(spark, "| a |\n```\nc\n```\n:--\nx") == [("text", None, "x")]
    assert tokens_of(spark, "| a |\nx\n:--\ny") == [("text", None, "x :-- y")]
    assert tokens_of(spark, "| a |\n\n:-- a") == [("text", None, ":-- a")]


def test_token_kinds(spark):
    text = "## T *x*\none\n![i](u)\ntwo\n- item\n3. num\n#######  seven\n# \n#\n- `gone`\nwww.a.fr\nend"
    assert tokens_of(spark, text) == [
        ("title", 2, "T x"), ("text", None, "one two"), ("bullet", None, "item"), ("bullet", None, "num"),
        ("text", None, "#######  seven # #"), ("text", None, "end"),
    ]


def sentences_of(spark, block):
    return spark.createDataFrame([(block,)], "b string").select(segment.sentences(F.col("b"))).first()[0]


def test_short_sentences_merge_until_long_enough(spark):
    long = "x" * 80 + "."
    assert sentences_of(spark, f"Un. Deux. {long} Fin.") == [f"Un. Deux. {long}", "Fin."]
    assert sentences_of(spark, long) == [long]


def test_the_threshold_counts_the_sentence_alone(spark):
    long, almost, exact = "x" * 80 + ".", "y" * 78 + ".", "w" * 79 + "."
    assert sentences_of(spark, f"{long} {almost} z. {exact} q.") == [long, f"{almost} z.", exact, "q."]


def test_wide_gap_stops_a_merge_after_it_was_taken(spark):
    assert sentences_of(spark, "Un.  Deux. Trois.") == ["Un. Deux.", "Trois."]
    # The merged text also occurs literally further on, with the next sentence behind it.
    assert sentences_of(spark, "A.  B. C. A. B. C.") == ["A. B. C.", "A. B. C."]
    # It occurs, but the next sentence does not follow it.
    assert sentences_of(spark, "A.  B. C. A. B.") == ["A. B.", "C. A. B."]


def test_many_sentences_stay_in_order(spark):
    block = " ".join(f"{i:03d}{'y' * 80}." for i in range(1500))
    assert sentences_of(spark, block) == [f"{i:03d}{'y' * 80}." for i in range(1500)]


def phrases_of(spark, text):
    return [r["phrase"] for r in segment.phrases_flat(docs(spark, text)).orderBy("phrase_index").collect()]


def paragraphs_of(spark, text):
    rows = segment.paragraphs(docs(spark, text)).orderBy("paragraph_index").collect()
    assert [r["paragraph_index"] for r in rows] == list(range(len(rows)))
    return [(r["section_title"], [p["phrase"] for p in r["phrases"]]) for r in rows]


def test_phrases_are_distinct_within_a_document(spark):
    assert phrases_of(spark, "# A\n- b\n- B \n# a\n- c\n- 12") == ["A", "b", "c"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("", []),
        ("- a", [("", ["a"])]),
        ("# T", [("T", [])]),
        ("# T\n# T\n- a", [("T", []), ("T", ["a"])]),
        ("# T\n- a\n# T", [("T", ["a"])]),
        ("# 12\n- a\n# T\n# 34", [("", ["a"]), ("T", [])]),
        ("# T\n- T\n# U", [("T", ["T"]), ("U", [])]),
        ("- T\n# T", [("", ["T"])]),
        ("# T\n- a\n# U\n- a", [("T", ["a"]), ("U", [])]),
    ],
)
def test_paragraph_emission(spark, text, want):
    assert paragraphs_of(spark, text) == want


def test_scored_units_skip_bare_titles(spark):
    paragraphs = segment.paragraphs(docs(spark, "# T\n# U\n- a\n- b"))
    units = segment.scored_units(paragraphs).collect()
    assert [(r["phrase_index"], r["phrase"]) for r in units] == [(-1, "U"), (0, "a"), (1, "b")]
    assert [r["full_paragraph"] for r in segment.paragraph_contexts(paragraphs).collect()] == ["a b"]


def test_units_of_a_section_do_not_repeat_its_text(spark):
    text = "\n".join(f"- phrase number {i}" for i in range(3000))
    units = segment.scored_units(segment.paragraphs(docs(spark, text)))
    assert "full_paragraph" not in units.columns
    total = units.selectExpr("sum(length(phrase) + length(section_title)) AS n").first()["n"]
    assert total < 2 * len(text)


def test_simple_segments_count_kept_paragraphs_only(spark):
    long = "w" * 30
    rows = segment.simple_segments(docs(spark, f"{long}\nshort\n\nno\n## Titre\n{long}\n#\n{long}")).collect()
    assert [(r["paragraph_index"], r["section_title"], r["paragraph"]) for r in rows] == [
        (0, "Introduction", f"{long} short"), (1, "Titre", long), (2, "", long)
    ]


LINES = [
    "", "  ", "a.", "B c. D", "b", "a.  b", "# T", "# t", "## 12", "# ", "- a.", "* b", "1. c", "- ", "| x | y |", "|---|",
    ":--", "- -", "---", "```", "``` py", "![i](u)", "https://a.b", "www.a.b c", "*e* _f_ g", "[l](u) m", "`q`", "`q` r",
    "Une phrase assez longue pour ne plus rien absorber du tout, car elle a plus de quatre-vingts signes.", "fin! Oui? Non…  ok",
]


@pytest.fixture(scope="module")
def random_docs():
    rng = random.Random(7)
    return ["\n".join(rng.choice(LINES) for _ in range(rng.randint(0, 14))) for _ in range(1500)]


@pytest.mark.parametrize("what", ["tokens", "phrases", "paragraphs", "counts", "simple", "clean"])
def test_random_documents_match_the_window_formulation(spark, random_docs, what):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, 'f', ?)", list(enumerate(random_docs)))
    raw = """
raw_lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
md_lines AS (SELECT source AS source_folder, 'doc_' || doc_id || '.md' AS source_file, line_no, line FROM raw_lines)"""
    parts = (raw, X.tokens("md_lines"), X.SENTENCES, X.PHRASES)
    df = docs(spark, *random_docs)
    if what == "tokens":
        got, sql = segment.tokens(df), X.statement("SELECT * FROM tok", *parts[:2])
    elif what == "phrases":
        got, sql = segment.phrases_flat(df), X.statement("SELECT * FROM phrases", *parts)
    elif what == "paragraphs":
        got = segment.paragraph_phrases(segment.paragraphs(df))
        sql = X.statement("SELECT * FROM para_phrases", *parts, X.PARAGRAPHS)
    elif what == "counts":
        got = segment.phrase_counts(df).filter("n_phrases > 0")
        sql = X.statement("SELECT source_folder, source_file, count(*) AS n_phrases FROM phrases GROUP BY ALL", *parts)
    elif what == "simple":
        got = segment.simple_segments(df)
        sql = X.statement(
            f"SELECT {X.KEYS}, row_number() OVER (PARTITION BY {X.KEYS} ORDER BY line_no) - 1 AS paragraph_index, "
            "section_title, paragraph FROM sg WHERE length(paragraph) >= 30", raw, X.SIMPLE)
    else:
        got, sql = clean.clean_documents(df).select("source_folder", "source_file", "text"), X.statement(
            "SELECT * FROM clean_docs", raw, X.CLEAN)
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    want = sorted(map(repr, cursor.fetchall()))
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == want
