"""Token ids in ORC files: integer run-length encoding, row indexes, and Bloom filters on document ids.

Documents are dealt by ranges of doc_id and sorted before they are encoded (a range exchange samples its
input, so the encoding follows it and runs once). Each task writes its range as one file in ascending order,
with the number of its part and the ids before each document in it, so that files can be read stripe by
stripe in parallel and a lookup by doc_id skips files, stripes and row groups by their statistics and filters.

Null text counts as empty; a null doc_id comes first; rows that repeat a doc_id stand in the order of a
hash of their texts, by which they may also be parted. Invalid UTF-8 is read as U+FFFD.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, over_batches, prepare, valid
from .tokens import encoder, vocabulary

END = 2
OPTIONS = {
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true",
    "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "compression": "zstd",
}


def write_ids(documents: DataFrame, path: str, vocabulary_path: str | None = None) -> None:
    """part, doc_id, before (ids of the part's earlier documents) and ids of every document, as ORC at the path."""
    prepare(documents.sparkSession)
    vocab = vocabulary_path or vocabulary()
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), valid("text").alias("text"))
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]  # rows of one id are dealt by their texts
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def encode(batches):
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, offsets = encoder(vocab).with_end(batch["text"], END)
            n = len(offsets) - 1
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32)))
            arrays = [pa.array(np.full(n, part, np.int32)), batch["doc_id"], pa.array(before + offsets[:-1]), lists]
            before += int(offsets[-1])
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "doc_id", "before", "ids"])

    rows.mapInArrow(encode, "part int, doc_id long, before long, ids array<int>").write.options(**OPTIONS).orc(path)


def read_ids(spark, path: str) -> DataFrame:
    """doc_id, ids, and start (the ids of all documents before it) from the files alone."""
    stored = spark.read.schema("part int, doc_id long, before long, ids array<int>").orc(path)
    ends = stored.groupBy("part").agg(F.max(F.col("before") + F.size("ids")).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a part: as many as the writing stage had tasks, 16 bytes each.
    starts = ends.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return stored.join(F.broadcast(starts), "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "ids")


def store(documents: DataFrame) -> DataFrame:
    """Write the ids of all documents to shared storage and read them back."""
    path = new_path(documents.sparkSession, "ids")
    write_ids(documents, path)
    return read_ids(documents.sparkSession, path)


def summed(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""

    def sums(batch: pa.RecordBatch) -> dict:
        ids = batch["ids"]
        flat, ends = ids.flatten().to_numpy().astype("<u4"), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return {"doc_id": batch["doc_id"], "start": batch["start"], "n_tokens": pa.array(np.diff(ends).astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64())}

    return over_batches(stored, sums, "doc_id long, start long, n_tokens long, ids_crc32 long")
