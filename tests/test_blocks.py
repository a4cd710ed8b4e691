"""Documents in blocks of lines give what documents in rows give, at any block size."""

from __future__ import annotations

import random

import pytest

from sentivote.operators import blocks, clean, segment

LINES = [
    "A sentence of words. And one more that is long enough to stand alone, as it has more than eighty characters in it.", "two words", "# Title",
    "## Title", "- item one", "1. item", "| cell | x |", "|---|---|", "---", ":-- -", "```", "  ```py", "", "", "", "![x](y.png)", "   ", "  code", "\t",
    "https://example.com/x", "<b>bold</b> &amp; *text*", "12 34",
]
KEYS = ["source_folder", "source_file"]


def documents(spark, n, seed):
    r = random.Random(seed)
    rows = [("f", f"d{i}", "\n".join(r.choice(LINES) for _ in range(r.randrange(1, 25)))) for i in range(n)]
    rows += [("f", "empty", ""), ("f", "blank", "\n \n\n"), ("f", "open", "a\n```\n   \n\n  \n"), (None, "d1", "No folder here.\nStill none.")]
    return spark.createDataFrame(rows, "source_folder string, source_file string, text string")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, 250, 5).cache()


def by_document(rows, *fields):
    out = {}
    for r in rows:
        out.setdefault((r["source_folder"], r["source_file"]), []).append(tuple(r[f] for f in fields))
    return out


@pytest.mark.parametrize("size", [1, 2, 5, 100])
def test_cleaned_blocks_join_to_the_cleaned_document(docs, size):
    rows = blocks.clean_blocks(blocks.split_documents(docs, size)).orderBy("block_no").collect()
    got = {k: "\n".join(t for (t,) in v) for k, v in by_document(rows, "text").items()}
    want = {(r["source_folder"], r["source_file"]): r["text"] for r in clean.clean_documents(docs).collect()}
    assert got == {k: t for k, t in want.items() if t}


@pytest.mark.parametrize("size", [1, 3, 100])
def test_tokens_and_phrases_are_those_of_the_row_form(docs, size):
    cut = blocks.split_documents(docs, size)
    tokens = blocks.tokens_of_blocks(cut).orderBy("block_no", "piece_no").collect()
    assert by_document(tokens, "kind", "level", "text") == by_document(segment.tokens(docs).orderBy("tok_pos").collect(), "kind", "level", "text")
    phrases = blocks.phrases_of_blocks(cut).orderBy("phrase_index").collect()
    want = segment.phrases_flat(docs).orderBy("phrase_index").collect()
    assert by_document(phrases, "phrase_index", "phrase") == by_document(want, "phrase_index", "phrase")


def test_empty_tables_and_null_texts(spark, docs):
    nothing = blocks.split_documents(docs.limit(0), 3)
    assert blocks.clean_blocks(nothing).count() == 0 and blocks.phrases_of_blocks(nothing).count() == 0
    null = spark.createDataFrame([("f", "n", None)], docs.schema)
    assert blocks.split_documents(null, 3).count() == 0


def test_a_large_document_is_read_by_many_tasks(spark):
    """One document of 200,000 lines: its rows hold 500 lines each, and its code fences and blocks cross them."""
    part = "A line of prose that goes on.\n```\ncode\n\n\n\nmore\n```\n" + "It ends here.\n" * 40
    text = (part * 5_000)[:-1]
    one = spark.createDataFrame([("f", "big", text)], "source_folder string, source_file string, text string")
    rows = blocks.clean_blocks(blocks.split_documents(one, 500)).orderBy("block_no").collect()
    assert len(rows) == -(-(text.count("\n") + 1) // 500)
    assert "\n".join(r["text"] for r in rows) == clean.clean_documents(one).first()["text"]
