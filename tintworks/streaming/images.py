"""A stream of image files: each micro-batch of new files goes through the same plan as a batch read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..config import PipelineConfig
from ..plans.pipeline import Support, support_from_path, support_from_rgba


FILES_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def _give(support: Support, sink: Callable[[Support, int], None], epoch: int) -> None:
    # what a micro-batch keeps is freed with it
    with support:
        sink(support, epoch)


def stream_rgba(rgba: DataFrame, sink: Callable[[Support, int], None], config: PipelineConfig | None = None):
    """A writer for a stream of rgba rows in which an image never spans micro-batches."""
    return rgba.writeStream.foreachBatch(lambda batch, epoch: None if batch.isEmpty() else _give(support_from_rgba(batch, config), sink, epoch))


def stream_files(spark: SparkSession, path: str, sink: Callable[[Support, int], None], config: PipelineConfig | None = None, *, files_at_once: int = 1000):
    """A writer for image files as they arrive in a folder.  Images are independent, so no state is kept.

    Only paths pass through the driver, at most `files_at_once` in a micro-batch; files are read by executors.
    """
    files = spark.readStream.format("binaryFile").schema(FILES_SCHEMA).option("maxFilesPerTrigger", files_at_once).load(path).select("path")

    def each(batch: DataFrame, epoch: int) -> None:
        paths = [r["path"] for r in batch.collect()]
        if paths:
            _give(support_from_path(batch.sparkSession, paths, config), sink, epoch)

    return files.writeStream.foreachBatch(each)
