from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def rows_of(spark):
    """Rows of a DataFrame made of tuples, as dicts."""

    def run(df):
        return [r.asDict(recursive=True) for r in df.collect()]

    return run


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) with the usual and some clashing columns."""

    def make(rows, extra: str = "lang string, source string, n_chars long, id long, rep string, `a.b` int"):
        full = [(*r[:2], *(r[2:] or ("en", "src0", len(r[1] or ""), 7, "x", 1))) for r in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, {extra}")

    return make
