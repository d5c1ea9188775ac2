"""What the training-data operators share: reading tables, shared storage, chunks of texts."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch; a longer row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20
#: Rows of ids that one partition of a small table may hold, some MB.
PARTITION_ROWS = 100_000
#: Rows of a few numbers that are broadcast at most, some MB.
BROADCAST_ROWS = 1 << 16
#: Bytes of text that are split into words or chunks at a time.
PORTION = 1 << 21
#: Chunks whose values a worker keeps, and the most characters of one.
KEPT, SHORT = 1 << 15, 32

WORD = re.compile(r"\w+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what the session names in ``spark.checkpoint.dir``. Only where that is unset in local mode (tests) a
    temporary folder of this machine serves; on a cluster its lack is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + os.path.realpath(tempfile.mkdtemp(prefix="shared-"))
        spark.conf.set("spark.checkpoint.dir", named)
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def prepare(spark: SparkSession) -> SparkSession:
    """Arrow batches of bounded size, and a checkpoint folder."""
    shared_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: compute once and keep the rows as a Parquet table in the shared folder.

    Later steps read only the columns they need, and tasks without rows leave no file.
    """
    path = new_path(df.sparkSession, "settled")
    df.write.parquet(path)
    settled = df.sparkSession.read.schema(df.schema).parquet(path)
    settled._settled_at = path
    return settled


def release(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t._settled_at)


def narrowed(df: DataFrame) -> DataFrame:
    """A settled table in no more partitions than its rows need.

    Iterative steps shuffle small tables over and over; each task of theirs writes files of its own, and a table of
    one partition of bounded size needs no shuffle at all. Large tables keep their partitions.
    """
    few = df.coalesce(df.count() // PARTITION_ROWS + 1)
    few._settled_at = df._settled_at
    return few


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of new_path that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def over_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str) -> DataFrame:
    """Run f on every Arrow batch, inside the tasks; a dict of columns may be returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                out = f(batch)
                yield pa.RecordBatch.from_pydict(out) if isinstance(out, dict) else out
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """At the end of a task, return the worker's freed memory to the system: Spark keeps workers for later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def checked(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A settled table of narrow rows, marked for a broadcast if it has few rows; else it is joined by a shuffle."""
    return F.broadcast(small) if small.count() <= rows else small


def split_hot(rows: DataFrame, counts: DataFrame, key: str, most: int, by: str) -> tuple[DataFrame, DataFrame]:
    """Part the keys of many rows, so that a join by key and part leaves no key whole to one task.

    counts has the `n` of each key, settled. Gives rows with their `part` (0 for most keys), and counts with
    each `part` and the number of `parts`. What is broadcast are keys of over `most` rows; `most` rises with
    the total, so that there are BROADCAST_ROWS of them at most.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    most = max(most, total // BROADCAST_ROWS)
    parts = F.ceil(F.col("n") / most).cast("int")
    hot = F.broadcast(counts.where(F.col("n") > most).select(key, parts.alias("_parts")))
    rows = rows.join(hot, key, "left").withColumn("part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.col("_parts"))).cast("int")).drop("_parts")
    return rows, counts.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))


def blocks(rows: DataFrame, key: str, most: int, weight: str | None = None, counted: DataFrame | None = None) -> DataFrame:
    """Deal the rows of each `bucket` of over `most` rows (or of that sum of weights) as pairs of blocks of about that size.

    Adds `block` and `pair` (the two block numbers in one long). Two rows of a bucket meet in one pair at least; rows
    of different blocks in the pair of these alone. counted: the same rows with fewer columns, for counting.
    """
    size = F.sum(weight) if weight else F.count("*")
    large = (rows if counted is None else counted).groupBy("bucket").agg(F.count("*").alias("n"), size.cast("long").alias("_size")).where(F.col("_size") > most)
    large = narrowed(settle(large.withColumn("_blocks", F.ceil(F.col("_size") / (most * 0.9)))))
    found = large.count()
    if not found:
        return rows.withColumns({"block": F.lit(0).cast("long"), "pair": F.lit(0).cast("long")})
    if found <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(large.select("bucket", "_blocks")), "bucket", "left")
    else:
        rows, parted = split_hot(rows, large, "bucket", 1 << 16, key)
        rows = rows.join(parted.select("bucket", "part", "_blocks"), ["bucket", "part"], "left").drop("part")
    rows = rows.withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(key), F.col("_blocks")))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    pair = F.shiftleft(F.least("block", "_other").cast("long"), 32) + F.greatest("block", "_other")
    return rows.withColumn("pair", pair).drop("_blocks", "_other")


def grouped(rows: DataFrame) -> DataFrame:
    """Rows of a bucket and pair stand together in one task."""
    return rows.repartition("bucket", "pair").sortWithinPartitions("bucket", "pair")


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, str]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys, in batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        k = np.stack([batch[c].to_numpy() for c in keys], 1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1), len(k)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            if held and tuple(k[lo]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = tuple(k[lo])
    if held:
        yield pa.Table.from_batches(held)


def views(column: pa.Array | pa.ChunkedArray, dtype: str) -> list[np.ndarray | None]:
    """The values of a binary column as arrays over Arrow's own memory; None for nulls."""
    out = []
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        _, offsets, data = chunk.buffers()
        at = np.frombuffer(offsets, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1].tolist()
        kind = np.dtype(dtype)
        for lo, hi, there in zip(at[:-1], at[1:], chunk.is_valid().to_pylist(), strict=True):
            out.append(np.frombuffer(data, kind, (hi - lo) // kind.itemsize, lo) if there and hi > lo else np.empty(0, kind) if there else None)
    return out


def portions(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in slices of about PORTION bytes; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PORTION, side="right")))
        yield texts.slice(lo, hi - lo)
        lo = hi


class ChunkCoder:
    """Values of the chunks of texts between blanks and line feeds, gathered for portions of Arrow batches.

    Arrow splits the texts and numbers their distinct chunks; `learn` computes the values (fixed-width items, as
    bytes) of each of them once, and numpy puts the items of all chunks together in order. `learn` must give for a
    text what its chunks give one after another. Values of at most `kept` short chunks, some 250 bytes each, are kept
    for the next portions; so a worker's memory follows the portion's bytes, not what it has seen.
    """

    def __init__(self, learn: Callable[[list[str]], list[bytes]], dtype: str, parted: Callable[[pa.Array], pa.Array] | None = None, kept: int = KEPT):
        self.learn, self.dtype, self.kept, self.known = learn, np.dtype(dtype), kept, {}
        #: Gives the texts with one blank between chunks.
        self.parted = parted or (lambda texts: pc.replace_substring(texts, "\n", " "))

    def _values(self, chunks: list[str]) -> list[bytes]:
        found = list(map(self.known.get, chunks))
        at = [i for i, v in enumerate(found) if v is None]
        if at:
            missing = [chunks[i] for i in at]
            fresh = self.learn(missing)
            for i, v in zip(at, fresh, strict=True):
                found[i] = v
            if len(self.known) + len(missing) > self.kept:
                self.known.clear()
            pairs = zip(missing[: self.kept], fresh, strict=False)
            self.known.update(pairs if max(map(len, missing)) <= SHORT else ((c, v) for c, v in pairs if len(c) <= SHORT))
        return found

    def _portion(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = pc.split_pattern(self.parted(texts), " ")
        coded = parts.flatten().dictionary_encode()
        codes, blobs = coded.indices.to_numpy(), self._values(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        pool = np.frombuffer(b"".join(blobs), self.dtype)
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // self.dtype.itemsize
        begins, sizes = (np.cumsum(sizes) - sizes)[codes], sizes[codes]
        ends = np.cumsum(sizes)
        places = np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        offsets = parts.offsets.to_numpy()
        return pool[places], np.diff(np.concatenate([[0], ends])[offsets - offsets[0]])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The items of all texts, and where each text's items begin and end (one number more than texts)."""
        items, counts = [np.empty(0, self.dtype)], [np.zeros(1, np.int64)]
        for part in portions(texts.cast(pa.large_string()).fill_null("")):
            found, n = self._portion(part)
            items.append(found)
            counts.append(n)
        return np.concatenate(items), np.cumsum(np.concatenate(counts))


def valid(column: str | Column) -> Column:
    """Text with invalid UTF-8 replaced by U+FFFD, the rule of all operators that read characters."""
    return F.make_valid_utf8((F.col(column) if isinstance(column, str) else column).cast("string"))


def valid_texts(column: pa.Array) -> pa.Array:
    """The same for texts that travel with other columns."""
    try:
        column.validate(full=True)
    except pa.ArrowInvalid:
        return pa.array([None if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()], pa.string())
    return column


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def id_crc(column: str = "doc_id"):
    """crc32 of the id as text; null for a null id."""
    return F.crc32(F.col(column).cast("string"))
