"""Runs of tables that show together or not at all."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sentivote.sources.published import publish_run, published_runs, read_run


def values(spark, root, name, run=None):
    return sorted(r[0] for r in read_run(spark, root, name, run).collect())


def test_a_killed_run_shows_the_one_before_and_goes_on(spark, tmp_path):
    root, made = str(tmp_path / "reports"), lambda a, n: spark.range(a, a + n)
    with pytest.raises(ValueError):
        read_run(spark, root, "one")
    publish_run({"one": made(0, 3), "two": made(10, 2)}, root, "r1")
    broken = spark.range(5).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        publish_run({"one": made(100, 3), "two": broken}, root, "r2")
    assert (values(spark, root, "one"), values(spark, root, "two")) == ([0, 1, 2], [10, 11])
    # the finished table isn't made again, the broken one is
    publish_run({"one": broken, "two": made(200, 2)}, root, "r2")
    assert (values(spark, root, "one"), values(spark, root, "two")) == ([100, 101, 102], [200, 201])
    assert values(spark, root, "one", "r1") == [0, 1, 2]
    # a published run stays as it is
    publish_run({"one": broken, "two": broken}, root, "r2")
    assert published_runs(spark, root).count() == 2


def test_empty_tables_and_names_that_are_not_there(spark, tmp_path):
    root = str(tmp_path / "reports")
    publish_run({"none": spark.range(0)}, root, "r1")
    assert read_run(spark, root, "none").count() == 0
    with pytest.raises(ValueError):
        read_run(spark, root, "none", "r7")
    with pytest.raises(ValueError):
        read_run(spark, root, "other")
    with pytest.raises(ValueError):
        publish_run({}, root, "r2")
