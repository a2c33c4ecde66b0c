"""Inbox as a stream (A1, B11, G1): new files -> one change run per micro-batch.

A ``binaryFile`` file stream with ``trigger(availableNow=True)`` picks up
every file not yet seen (the checkpoint remembers them, so a restart or a
re-run reprocesses nothing); ``foreachBatch`` hands each micro-batch of files
to the batch pipeline with ``run_id = <stream id>-<batch id>``, so a retried
micro-batch rewrites the same run partitions.  ``cleanSource=archive`` moves
consumed files out of the inbox instead of deleting them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fs
from ..sources.workbook import csv_part, read_paths

BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def inbox_stream(spark: SparkSession, inbox: str, max_files_per_batch: int | None = None,
                 archive_dir: str | None = None) -> DataFrame:
    r = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
         .option("recursiveFileLookup", "true"))
    if max_files_per_batch:
        r = r.option("maxFilesPerTrigger", str(max_files_per_batch))
    if archive_dir:
        r = r.option("cleanSource", "archive").option("sourceArchiveDir", archive_dir)
    return r.load(inbox)


def parsed_batch(files: DataFrame, batch_id: int) -> DataFrame:
    """Micro-batch of files -> parsed cells with file order and authors text.

    Only the names come to the driver; the contents are read by the batch reader, CSV by splits.
    (Spark's file stream passes over files of no bytes.)"""
    from ..plans.pipeline import _with_file_order

    paths = [r["path"] for r in files.select("path").collect()]
    _check_parts(files.sparkSession, paths)
    return _with_file_order(read_paths(files.sparkSession, paths)).withColumn("batch_id", F.lit(batch_id))


def _check_parts(spark: SparkSession, paths: list[str]) -> None:
    """A CSV file in parts must come whole: rows of half a file would get wrong numbers and no header."""
    here = {part for p in paths if (part := csv_part(p))}
    for folder in sorted({f for f, _ in here}):
        if lost := {part for p, _, _ in fs.files(spark, folder, empty=False) if (part := csv_part(p))} - here:
            raise ValueError(f"{len(lost)} parts of {folder} are not in its micro-batch: move folders in whole, raise max_files_per_batch")


def run_stream(spark: SparkSession, inbox: str, checkpoint: str,
               handle: Callable[[DataFrame, int], None], *, max_files_per_batch: int | None = None,
               archive_dir: str | None = None) -> None:
    """Process everything available now, then stop; returns when all of it is done, or raises."""
    # the batch reader reads the files by splits; here they would be read whole
    q = (inbox_stream(spark, inbox, max_files_per_batch, archive_dir).drop("content").writeStream
         .foreachBatch(lambda df, bid: handle(parsed_batch(df, bid), bid))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
