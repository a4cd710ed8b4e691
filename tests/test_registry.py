"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import check_oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from sentivote.plans import queries as registered  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    return check_oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(registered.registry()))
def test_query_matches_its_twin(spark, con, sf, name):
    line = check_oracle.compare(spark, con, name, sf)
    assert line.startswith("ok"), line


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_a_twin():
    assert set(registered.registry()) <= set(entry.oracle_sql())
