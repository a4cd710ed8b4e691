"""Runs of report tables that become visible together.

Each run's tables have a folder of their own, and readers take the run that the manifest names last.  The manifest gets
its row after all tables are written, so a run that was killed shows nothing and the run before it stays whole.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "run string, tables array<string>, published_at timestamp"
PROGRESS = "run string, name string"


def _known(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small table, empty if nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _place(root: str, run: str, name: str) -> str:
    return f"{root.rstrip('/')}/runs/{run}/{name}"


def publish_run(tables: Mapping[str, DataFrame], root: str, run: str) -> None:
    """Write all ``tables`` of ``run`` and show them at once.

    If the run was interrupted, the same call goes on: tables that were finished aren't made again,
    one that was begun is written anew.  A run that was published is left as it is.
    """
    if not tables:
        raise ValueError("a run needs at least one table")
    spark, base = next(iter(tables.values())).sparkSession, root.rstrip("/")
    if published_runs(spark, root).where(F.col("run") == run).count():
        return
    finished = {r["name"] for r in _known(spark, f"{base}/progress", PROGRESS).where(F.col("run") == run).collect()}
    for name, df in tables.items():
        if name not in finished:
            df.write.mode("overwrite").parquet(_place(root, run, name))
            spark.createDataFrame([(run, name)], PROGRESS).coalesce(1).write.mode("append").parquet(f"{base}/progress")
    row = spark.range(1, numPartitions=1).select(
        F.lit(run).alias("run"), F.array(*[F.lit(n) for n in tables]).alias("tables"), F.current_timestamp().alias("published_at")
    )
    row.write.mode("append").parquet(f"{base}/manifest")


def published_runs(spark: SparkSession, root: str) -> DataFrame:
    """One row per published run: run, tables, published_at."""
    return _known(spark, f"{root.rstrip('/')}/manifest", MANIFEST)


def read_run(spark: SparkSession, root: str, name: str, run: str | None = None) -> DataFrame:
    """A table of a published run, of the last one unless ``run`` is given."""
    runs = published_runs(spark, root)
    found = (runs if run is None else runs.where(F.col("run") == run)).orderBy(F.desc("published_at"), F.desc("run")).first()
    if found is None or name not in found["tables"]:
        raise ValueError(f"no published run has the table {name}")
    return spark.read.parquet(_place(root, found["run"], name))
