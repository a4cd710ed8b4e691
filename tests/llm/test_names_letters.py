"""Internal names don't clash with columns, letters of any script count, spans stay linear."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from sentivote.llm import cross_parse, importance, near_join, secret_scan

CLASHING = "_id long, _h long, _q string, _g int, _key long, key long, gain double, w double, again boolean, gone long"
FILL = (1, 2, "q", 3, 4, 5, 0.5, 0.25, True, 6)


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "en", *FILL) for i, t in rows], f"doc_id long, text string, lang string, {CLASHING}")


def prose(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioulnrst") for _ in range(r.randrange(2, 8))) for _ in range(n))


def test_kept_documents_keep_clashing_columns(spark):
    rows = [(i, prose(i)) for i in range(12)] + [(50, prose(3)), (3, prose(3)), (4, prose(99)), (None, prose(1)), (60, None)]
    docs = clashing(spark, rows)
    kept = near_join.kept_documents(docs)
    assert kept.columns == docs.columns
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in kept.collect())
    assert got == sorted([(i, prose(i)) for i in range(12)] + [(4, prose(99)), (-1, prose(1)), (60, "")])
    assert all(tuple(r)[3:] == FILL for r in kept.collect())
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    for out in (importance.kept_documents(docs, labels), cross_parse.kept_documents(docs)):
        assert out.columns == docs.columns and all(tuple(r)[3:] == FILL for r in out.collect())
    assert near_join.kept_documents(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def scripts():
    han, other, hangul = [[chr(a + 3 * i) for i in range(2500)] for a in (0x4E00, 0x4E01, 0xAC00)]
    latin = [chr(c) for c in range(97, 123)]
    return {"a": han, "b": other, "c": hangul, "d": latin}


def text_in(letters, seed, n):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(letters, 8)) for _ in range(n))


def test_languages_of_thousands_of_letters_are_told_apart(scripts):
    model = cross_parse.Model({lang: text_in(letters, k, 2500) for k, (lang, letters) in enumerate(scripts.items())})
    texts, want = [], []
    for k, (lang, letters) in enumerate(scripts.items()):
        for seed in range(25):
            texts.append(text_in(letters, 100 + 50 * k + seed, 40))
            want.append(lang)
    assert [lang for lang, _ in model.predict(texts)] == want


def test_transitions_equal_a_dictionary():
    r = random.Random(4)
    pairs = {(r.randrange(3000), r.randrange(2, 5000)): r.randrange(3000) for _ in range(9000)}
    table = cross_parse.Transitions(*[np.array(x, np.int64) for x in zip(*pairs)], np.array(list(pairs.values()), np.int32))
    asked = list(pairs) + [(r.randrange(3000), r.randrange(2, 5000)) for _ in range(9000)]
    got = table.follow(*[np.array(x, np.int64) for x in zip(*asked)])
    assert got.tolist() == [pairs.get(p, -1) for p in asked]


def test_spans_of_a_text_with_very_many_matches(spark):
    n = 20_000
    one = spark.createDataFrame([(1, "token: abcdefgh12 " * n)], "doc_id long, text string")
    start = time.time()
    row = secret_scan.digest(one).first()
    assert row["n_assign"] == n and time.time() - start < 20
    assert row["spans"].split(",")[-1] == f"assign:{18 * (n - 1)}:{18 * n - 1}"
    assert row["spans"].split(",") == [f"assign:{18 * i}:{18 * i + 17}" for i in range(n)]
