"""Keeping an index up to date from a stream of new message files or listing rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index

FILES = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, folder: str, glob: str = "*.eml") -> DataFrame:
    """A stream of whole files as they appear."""
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)


def once(rows: DataFrame, key: str = "key", time: str = "date", late: str = "7 days") -> DataFrame:
    """Drops repeats of a key that arrive within the watermark; the state is bounded by it."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def index_stream(files: DataFrame, listed: Callable[[DataFrame], DataFrame], index: Index, checkpoint: str) -> StreamingQuery:
    """Each batch of files is listed and merged into the index. A repeated batch changes nothing: its keys are known."""

    def merge(batch: DataFrame, _: int) -> None:
        rows = listed(batch).persist()
        prints = rows.groupBy("source_name").agg(F.sum("size").alias("size"), F.max(F.unix_timestamp("date")).cast("double").alias("mtime"))
        index.update(rows, prints, complete=False)
        rows.unpersist()

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
