"""Session settings for local runs, and how to cut a lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "sentivote", memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and the bench.  Clusters bring their own."""
    n = os.cpu_count() if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_own_folder: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the checkpoint folder.

    The folder is the one the cluster names in ``spark.checkpoint.dir``, shared
    by all executors.  Only a session on one machine that names none, as in tests, gets a
    temporary folder.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="sentivote-checkpoint-"))
        folder = _own_folder[0]
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet to the checkpoint folder and go on from the written copy.

    Losing executors loses no result.
    """
    spark = df.sparkSession
    path = shared_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
