"""The registered queries of the subpackage, and their SQL twins on the smallest tables."""

from __future__ import annotations

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import check_oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from sentivote.llm import queries, sql  # noqa: E402


def test_all_are_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} <= {re.match(r"op\d+|.*", q).group() for q in names}
    assert "pipeline" in names and set(sql.sql()) <= set(queries.registry())


@pytest.mark.parametrize("name", sorted(sql.sql()))
def test_query_matches_its_twin(spark, sf, name):
    line = check_oracle.compare(spark, check_oracle.connect(sf), name, sf)
    assert line.startswith("ok"), line


@pytest.mark.parametrize("name", sorted(queries.registry()))
def test_query_runs_without_writing_outside_the_shared_folder(spark, sf, name):
    assert queries.registry()[name](spark, sf).count() > 0
