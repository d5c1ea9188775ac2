"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Rows get gapless numbers that depend on the rows alone (not on files, partitions or retries): a bucket by
hash, the rows before the bucket, and the place within it; rows that are equal are counted first and numbered
as a run, so that a row that repeats without end fills no bucket. A keyed Feistel network over the smallest even
number of bits that holds all rows, walked along its cycle until the value is a row number again, permutes
the numbers. Position p belongs to shard p mod S at slot p div S: shard sizes differ by one at most, slots
are gapless, and both are computable from a row number alone, in either direction (`locate`, `row_at`).

Nulls: a null id or text takes part like any other value (crc and bytes of a null text are those of the
empty text). Rows that are equal get different numbers. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, settle

ROUNDS = 6
#: Rows of a numbering bucket on average, and the most buckets; their totals are all that is broadcast (16 bytes each).
BUCKET_ROWS, MOST_BUCKETS = 4096, 1 << 16
#: Equal rows that one row of counts is written out to at a time.
COPIES = 1 << 16


def _half_bits(n: int) -> int:
    return max(1, (max(1, n - 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, half: int, seed: int, back: bool) -> np.ndarray:
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> h, x & mask
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        key = np.uint64((seed * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) & (2**64 - 1))
        if back:
            left, right = right ^ (mix64(left ^ key) & mask), left
        else:
            left, right = right, left ^ (mix64(right ^ key) & mask)
    return (left << h) | right


def permute(rows: np.ndarray, n: int, seed: int = 0, back: bool = False) -> np.ndarray:
    """The permutation of 0..n-1 (or its inverse), by cycle walking in a domain under 4n."""
    half = _half_bits(n)
    x = _network(np.asarray(rows, np.uint64), half, seed, back)
    while (out := x >= np.uint64(n)).any():
        x[out] = _network(x[out], half, seed, back)
    return x.astype(np.int64)


def locate(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    p = int(permute(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def number_rows(df: DataFrame, hash_column: str, order: list[str], into: str = "row") -> tuple[DataFrame, int]:
    """Global row numbers 0..n-1 by buckets of the hash; hash, order and any other columns of df should be narrow."""
    each = settle(df.groupBy(*df.columns).agg(F.count("*").alias("_copies")))
    n, most = each.agg(F.coalesce(F.sum("_copies"), F.lit(0)), F.coalesce(F.max("_copies"), F.lit(0))).first()
    buckets = min(MOST_BUCKETS, max(16, 1 << max(1, n // BUCKET_ROWS).bit_length()))
    each = each.withColumn("_bucket", F.pmod(F.col(hash_column), F.lit(buckets)).cast("int"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # At most MOST_BUCKETS rows, whatever the input.
    starts = each.groupBy("_bucket").agg(F.sum("_copies").alias("_n")).select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_bucket").orderBy(hash_column, *order).rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("_place", F.coalesce(F.sum("_copies").over(within), F.lit(0)))
    each = each.join(F.broadcast(starts), "_bucket").withColumn("_first", F.col("_start") + F.col("_place"))
    if most > COPIES:  # runs of very many equal rows are spread over tasks before they are written out
        each = each.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(COPIES).cast("long")))).repartition("_first", "_from")
    else:
        each = each.withColumn("_from", F.lit(0).cast("long"))
    copy = F.explode(F.sequence("_from", F.least(F.col("_from") + COPIES, F.col("_copies")) - 1))
    rows = each.withColumn("_copy", copy).withColumn(into, F.col("_first") + F.col("_copy"))
    return rows.drop("_bucket", "_place", "_start", "_copies", "_first", "_from", "_copy"), n


def shard(documents: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, row, position, shard, slot of every row, under the law `rows`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64("doc_id", "text").alias("_hash"))
    numbered, n = number_rows(narrow, "_hash", ["doc_id", "text_crc32", "size"])

    @F.pandas_udf("long")
    def position(row):
        import pandas as pd

        return pd.Series(permute(row.to_numpy(), n, seed))

    return numbered.withColumn("position", position("row")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("position") % shards).cast("int").alias("shard"),
        F.floor(F.col("position") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row", "position",
    )
