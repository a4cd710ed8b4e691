"""New files only: the incremental run as a stream over a folder.

The file source remembers in its checkpoint which files it has read, so a
rerun works on the files that arrived since.  Every micro-batch overwrites its
own folder of results: repeated after a lost driver, it replaces what it had
written and doubles nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentivote.functions import paths


def markdown_stream(spark: SparkSession, root: str, files_per_batch: int | None = None) -> DataFrame:
    """Markdown files below ``root`` as a stream of whole documents."""
    reader = spark.readStream.format("text").option("wholetext", True)
    reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rel = paths.relative(F.col("_metadata.file_path"), paths.qualified(spark, root))
    return reader.load(root).select(
        paths.folder(rel).alias("source_folder"),
        paths.file_name(rel).alias("source_file"),
        F.regexp_replace("value", "\\r\\n?", "\n").alias("text"),
    )


def process_new(
    stream: DataFrame, work: Callable[[DataFrame], DataFrame], out_dir: str, checkpoint_dir: str, output_mode: str = "append"
) -> int:
    """Run ``work`` on everything new, write Parquet, return the batches run."""

    done = set()

    def write(batch: DataFrame, batch_id: int) -> None:
        done.add(batch_id)
        work(batch).write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch={batch_id}")

    spark = stream.sparkSession
    # a state that can time out would ask for one empty batch after the other and never end
    empty, before = "spark.sql.streaming.noDataMicroBatches.enabled", None
    if output_mode == "update":
        before = spark.conf.get(empty)
        spark.conf.set(empty, "false")
    try:
        query = (
            stream.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint_dir)
            .outputMode(output_mode)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        if before is not None:
            spark.conf.set(empty, before)
    query.awaitTermination()
    return len(done)


def results(spark: SparkSession, out_dir: str) -> DataFrame:
    """Everything written so far."""
    return spark.read.parquet(out_dir)
