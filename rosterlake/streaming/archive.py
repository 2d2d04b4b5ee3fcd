"""Streaming twin of the page archive: new fetches are merged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rosterlake.sources.tables import archive_merge, archive_union


def run_archive(fetches: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch, merged within itself, to `folder`/batch=n; a batch that is tried again overwrites its own folder.

    A batch costs what it holds, whatever the archive holds; `archive` merges on reading.
    """

    def merge(batch: DataFrame, number: int) -> None:
        archive_merge(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return fetches.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def archive(spark: SparkSession, folder: str) -> DataFrame:
    """The archive of all batches in `folder`: a row a (url, content)."""
    return archive_union(spark.read.parquet(folder).drop("batch"))


def compact(spark: SparkSession, folder: str, into: str) -> None:
    """The archive of `folder` as one batch of the new folder `into`, for a stream that goes on there with a new checkpoint."""
    archive(spark, folder).write.mode("errorifexists").parquet(f"{into}/batch=-1")
