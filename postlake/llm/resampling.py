"""Importance resampling towards a target: hashed n-gram features whose CRCs are combined, never the strings.

Words are runs of the bytes 0-9, a-z (A-Z lower-cased) and of all bytes beyond ASCII, found by numpy on the UTF-8 bytes of
a batch. Each word's CRC-32 is computed once; the CRC of a run of words follows by algebra: appending B to A turns
crc(A) into shift(crc(A), len(B)) xor crc(B), where the shift by a number of bytes is a linear map over GF(2), a power of the
one of a zero byte. No n-gram string is ever made, whatever the length of runs.

Two passes over the texts: the first counts features in buckets (each task sends its counts, at most one row a bucket),
the second scores documents with one gain per bucket. The drawn share is settled by the counts of scores (whole numbers
of a bounded span, however many documents there are); only rows from that score on are put in order, dealt by ranges
of score, id and row, and numbered by range.

Null texts have no words; invalid UTF-8 is taken byte by byte. A null id sorts last and hashes as an empty one. Rows that
repeat an id and score are ranked apart, in either order.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PORTION, new_path, over_batches, prepare, settle

BUCKETS, LONGEST_RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Longer words get their CRC from zlib, one by one.
LOCKSTEP = 48
#: The reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


TABLE = _byte_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def times(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A 32 x 32 matrix over GF(2), given by its columns, times vectors of 32 bits."""
    out = np.zeros_like(values)
    for bit in range(32):
        out ^= np.where(values >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0)).astype(np.uint32)
    return out


class Shifts:
    """What appending a number of bytes does to a CRC: powers of the map of one zero byte, kept as byte tables."""

    def __init__(self):
        unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
        self.powers = [TABLE[unit & np.uint32(255)] ^ unit >> np.uint32(8)]  # of 1, 2, 4 ... bytes
        self.known: dict[int, np.ndarray] = {}

    def matrix(self, n: int) -> np.ndarray:
        out, k = np.uint32(1) << np.arange(32, dtype=np.uint32), 0
        while n:
            while len(self.powers) <= k:
                self.powers.append(times(self.powers[-1], self.powers[-1]))
            if n & 1:
                out = times(self.powers[k], out)
            n, k = n >> 1, k + 1
        return out

    def tables(self, n: int) -> np.ndarray:
        """The map of n bytes for each value of each byte of a CRC."""
        if n not in self.known:
            if len(self.known) > 4096:
                self.known.clear()
            m, bytes_ = self.matrix(n), np.arange(256, dtype=np.uint32)
            self.known[n] = np.stack([times(m, bytes_ << np.uint32(8 * k)) for k in range(4)])
        return self.known[n]

    def apply(self, crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        sizes, at = np.unique(lengths, return_inverse=True)
        if not len(sizes):
            return crcs
        tables = np.stack([self.tables(int(n)) for n in sizes])
        return np.bitwise_xor.reduce([tables[at, k, crcs >> np.uint32(8 * k) & np.uint32(255)] for k in range(4)])


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each word data[start:end], all words a byte at a time."""
    sizes = ends - starts
    order = np.argsort(-np.minimum(sizes, LOCKSTEP + 1), kind="stable")
    sizes_in, at = sizes[order], starts[order]
    long = int(np.searchsorted(-sizes_in, -LOCKSTEP, side="left")) if len(order) else 0
    crcs = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for i in range(int(sizes_in[long]) if long < len(order) else 0):
        live = slice(long, int(np.searchsorted(-sizes_in, -i, side="left")))  # words longer than i
        crcs[live] = TABLE[(crcs[live] ^ data[at[live] + i]) & np.uint32(255)] ^ crcs[live] >> np.uint32(8)
    crcs = ~crcs
    for i in range(long):
        crcs[i] = zlib.crc32(data[at[i] : at[i] + sizes_in[i]])
    out = np.empty_like(crcs)
    out[order] = crcs
    return out


def features(texts: pa.Array, longest: int = LONGEST_RUN, shifts: Shifts | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of a binary array: first text, end, words of each text, and CRC and text (from the first) of every feature."""
    shifts = shifts or Shifts()
    column = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, buffer = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(buffer, np.uint8) if buffer else np.empty(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + PORTION, side="right")) - 1)
        data = _LOWER[whole[at[lo] : at[hi]]]
        inside = _IS_WORD[data]
        cuts = np.unique(at[lo : hi + 1] - at[lo])  # words end with their texts
        before = np.concatenate([[False], inside[:-1]])
        before[cuts[cuts < len(data)]] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.concatenate([inside[1:], [False]])
        after[cuts[cuts > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        text = np.searchsorted(at[lo : hi + 1] - at[lo], starts, side="right") - 1
        word, sizes = word_crcs(data, starts, ends), ends - starts
        runs, owners, run = [word], [text], word
        for n in range(2, longest + 1):
            if len(run) < 2:
                break
            # crc of "run word": the run, a blank, the word n - 1 places on; runs across texts are left out.
            follow = word[n - 1 :]
            blank = np.full(len(run) - 1, zlib.crc32(b" "), np.uint32)
            run = shifts.apply(run[:-1], np.ones(len(run) - 1, np.int64)) ^ blank
            run = shifts.apply(run, sizes[n - 1 :]) ^ follow
            same = text[: len(run)] == text[n - 1 :]
            runs.append(run[same])
            owners.append(text[: len(run)][same])
        yield lo, hi, np.bincount(text, minlength=hi - lo), np.concatenate(runs), np.concatenate(owners)
        lo = hi


def bucket_counts(rows: DataFrame, text_column: str = "text", longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, shifts = np.zeros(buckets, np.int64), Shifts()
        for batch in batches:
            for _, _, _, crcs, _ in features(batch["_text"], longest, shifts):
                total += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used), "n": pa.array(total[used])})

    found = rows.select(F.col(text_column).cast("binary").alias("_text")).mapInArrow(run, "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def _counted(rows: DataFrame, longest: int, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    for r in bucket_counts(rows, longest=longest, buckets=buckets).collect():  # at most one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio) of each bucket; counts are exact, the ratio is a double."""
    s_all, t_all, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(documents: DataFrame, gain: np.ndarray, longest: int = LONGEST_RUN) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""

    def of(batch: pa.RecordBatch) -> dict:
        words, counts, sums = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
        shifts = Shifts()
        for lo, hi, n_words, crcs, owners in features(batch["_text"], longest, shifts):
            words[lo:hi] = n_words
            counts[lo:hi] = np.bincount(owners, minlength=hi - lo)
            order = np.argsort(owners, kind="stable")
            running = np.concatenate([[0], np.cumsum(gain[crcs[order] % np.uint32(len(gain))])])
            ends = np.cumsum(counts[lo:hi])
            sums[lo:hi] = running[ends] - running[ends - counts[lo:hi]]
        return {"doc_id": batch["doc_id"], "n_words": pa.array(words), "n_features": pa.array(counts), "weight": pa.array(sums // np.maximum(counts, 1))}

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("_text"))
    return over_batches(rows, of, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int = SEED):
    """floor(1000 times a Gumbel variate), drawn from the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST_RUN, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null where it isn't drawn."""
    spark = prepare(documents.sparkSession)
    gain = gains(_counted(documents, longest, buckets), _counted(target, longest, buckets))
    scored = weights(documents, gain, longest).withColumn("score", (F.col("weight") + gumbel(seed)).cast("long"))
    # Once written, the number tells equal rows apart.
    scored = settle(scored.withColumns({"may": F.col("n_words") >= least_words, "at": F.monotonically_increasing_id()}).drop("n_words"))
    # Scores are whole numbers within some 100,000 of zero, so these are so many rows at most.
    tally = scored.where("may").groupBy("score").agg(F.count("*").alias("n"))
    of_scores = sorted(((r["score"], r["n"]) for r in tally.collect()), reverse=True)
    wanted = percent * sum(n for _, n in of_scores) // 100
    least, seen = None, 0
    for score, n in of_scores:
        if seen >= wanted:
            break
        least, seen = score, seen + n
    none = F.lit(None).cast("long").alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    if least is None:
        return scored.select(*columns, none)
    high = F.col("may") & (F.col("score") >= least)
    path = new_path(spark, "ranked")
    dealt = scored.where(high).repartitionByRange(F.desc("score"), F.asc_nulls_last("doc_id"), "at").sortWithinPartitions(F.desc("score"), F.asc_nulls_last("doc_id"), "at")
    dealt.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}).drop("may", "at").write.parquet(path)
    ranked = spark.read.parquet(path)
    # One row a range; a place counts from its range's number in the upper bits.
    sizes = ranked.groupBy("part").agg(F.count("*").alias("_n"), F.min("place").alias("_first"))
    base = F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ranked.join(F.broadcast(sizes.select("part", "_first", base.alias("_base"))), "part")
    rank = F.col("_base") + F.col("place") - F.col("_first") + 1
    return scored.where(~high).select(*columns, none).unionByName(ranked.select(*columns, F.when(rank <= wanted, rank).alias("rank")))


def oracle(percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> str:
    """The same for runs of one word; CRCs by the table of the polynomial, byte by byte, for distinct words."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    bits = "SELECT i, i AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, " + step + ", k + 1 FROM bits WHERE k < 8"
    words = lambda t: f"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH RECURSIVE bits AS ({bits}), crctable AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
        docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({words('text')}, []) AS ws FROM documents),
        doc_words AS (SELECT r, unnest(ws) AS w FROM docs), aim_words AS (SELECT unnest({words('text')}) AS w FROM benchmark),
        distinct_words AS (SELECT DISTINCT w FROM (SELECT w FROM doc_words UNION ALL SELECT w FROM aim_words)),
        crc(w, i, n, h, c) AS (SELECT w, 0, strlen(w), hex(w), 4294967295::BIGINT FROM distinct_words UNION ALL
            SELECT w, i + 1, n, h, xor(c >> 8, t[(xor(c, ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) & 255) + 1]) FROM crc, crctable WHERE i < n),
        hashed AS (SELECT w, xor(c, 4294967295) % {buckets} AS b FROM crc WHERE i = n),
        doc_buckets AS (SELECT r, b, count(*) AS n FROM doc_words JOIN hashed USING (w) GROUP BY r, b),
        s AS (SELECT b, sum(n)::BIGINT AS n FROM doc_buckets GROUP BY b), t AS (SELECT b, count(*) AS n FROM aim_words JOIN hashed USING (w) GROUP BY b),
        gain AS (SELECT s.b, floor(1000 * ln(((coalesce(t.n, 0) + 1) * ((SELECT sum(n)::BIGINT FROM s) + {buckets}))::DOUBLE / ((s.n + 1) * (coalesce((SELECT sum(n)::BIGINT FROM t), 0) + {buckets}))::DOUBLE))::BIGINT AS g FROM s LEFT JOIN t ON s.b = t.b),
        sums AS (SELECT r, sum(n)::BIGINT AS n, sum(n * g)::BIGINT AS g FROM doc_buckets JOIN gain USING (b) GROUP BY r),
        scored AS (SELECT d.r, doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (g - ((g % n) + n) % n) // n END AS weight,
            floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS luck
            FROM docs d LEFT JOIN sums ON d.r = sums.r),
        ranked AS (SELECT r, row_number() OVER (ORDER BY weight + luck DESC, doc_id NULLS LAST, r) AS k FROM scored WHERE n_features >= {least_words})
        SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, (weight + luck)::BIGINT AS score,
            CASE WHEN k <= {percent} * (SELECT count(*) FROM ranked) // 100 THEN k END::BIGINT AS rank FROM scored LEFT JOIN ranked ON scored.r = ranked.r"""
