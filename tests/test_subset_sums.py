"""Subset counts inside the row against the listed subsets."""

from __future__ import annotations

import random

import pytest
from sentivote import vocab
from sentivote.operators import sensitivity, subset_sums

from test_scale import exchanges, plan

SCHEMA = "source_folder string, source_file string, paragraph_index int, model string, categorie string, confiance double, erreur string"


def names(n: int) -> list[str]:
    return [f"maker/m.{i}" for i in range(n)]


def random_folds(spark, n: int, segments: int, seed: int):
    """Few confidences, so that sums often tie; some models failed, some didn't answer."""
    rng, rows = random.Random(seed), []
    for s in range(segments):
        for m in names(n):
            if rng.random() < 0.85:
                failed = rng.random() < 0.1
                rows.append(("f", "a.md", s, m, rng.choice(vocab.CATEGORIES), rng.choice([0.0, 0.1, 0.2, 0.3, 0.7]), "timeout" if failed else None))
    return sensitivity.fold(spark.createDataFrame(rows, SCHEMA), names(n))


def listed_rates(df, n: int) -> list[tuple]:
    return sorted(map(tuple, sensitivity.change_rates(sensitivity.leave_k_out(df, names(n))).collect()))


@pytest.mark.parametrize("n", [2, 3, 5, 7])
def test_counts_equal_the_listed_subsets(spark, n):
    df = random_folds(spark, n, 60, n).cache()
    got = subset_sums.change_rates(df, names(n))
    assert sorted(map(tuple, got.collect())) == listed_rates(df, n)
    assert got.columns == sensitivity.change_rates(sensitivity.leave_k_out(df, names(n))).columns
    score = lambda d: sorted((r["paragraph_index"], r["stability_score"]) for r in d.collect())
    assert score(subset_sums.with_stability(df, names(n))) == score(sensitivity.with_stability(df, names(n)))


@pytest.mark.parametrize("inner", [0, 1, 2, 5, 9])
def test_starting_points_do_not_change_the_counts(spark, inner):
    df = random_folds(spark, 6, 40, 3).cache()
    rows = subset_sums.changes(df, names(6), inner=inner).collect()
    by_segment: dict[int, list] = {}
    for r in sorted(sensitivity.change_rates(sensitivity.leave_k_out(df, names(6))).collect(), key=lambda r: r["k"]):
        by_segment.setdefault(r["paragraph_index"], []).append(r["nb_changes"])
    assert {r["paragraph_index"]: r["changes"] for r in rows} == by_segment


def test_one_model_and_no_rows(spark):
    one = random_folds(spark, 1, 3, 0)
    assert [r["changes"] for r in subset_sums.changes(one, names(1)).collect()] == [[]] * one.count()
    assert subset_sums.change_rates(one, names(1)).count() == 0
    assert subset_sums.with_stability(one, names(1)).first()["stability_score"] == 100.0
    assert subset_sums.change_rates(random_folds(spark, 4, 3, 1).limit(0), names(4)).count() == 0


def test_too_many_models_are_named(spark):
    with pytest.raises(ValueError, match="31"):
        subset_sums.changes(spark.range(1), names(31))


def test_more_models_than_one_starting_point_holds(spark):
    n = subset_sums.INNER + 3
    df = random_folds(spark, n, 2, 5).cache()
    got = subset_sums.change_rates(df, names(n))
    assert sorted(map(tuple, got.collect())) == listed_rates(df, n)


def test_no_exchange_after_the_fold(spark, tmp_path):
    path = str(tmp_path / "folded")
    random_folds(spark, 5, 20, 2).write.parquet(path)
    df = spark.read.parquet(path)
    for made in (subset_sums.change_rates(df, names(5)), subset_sums.with_stability(df, names(5))):
        assert exchanges(made) == 0 and "Aggregate" not in plan(made) and "Python" not in plan(made)
