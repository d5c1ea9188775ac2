"""Vector code compression: product quantisation whose assignments are Exponion searches in exact integers.

A component x becomes the integer floor(4096 x); a vector is cut into equal consecutive parts, and each part position
has a codebook of its own, refined by rounds of assignment and floored means. An assignment starts at the entry of the
round before, at the distance d, and scans that entry's neighbours in the order of their distance from it: an entry
further from it than 2 d can't be nearer than d (triangle inequality), and the first such neighbour ends the scan. All
distances are squared integers and ties go to the lower index, so the result equals a full search.

A round is one pass over the vectors: it writes them with their new codes to a settled table, and each task adds one
row with its sums and counts per entry, which are summed on Spark; only codebooks (16 entries for each of 8 parts) go
through the driver and into closures. Nothing else is shuffled but the sums of error per label.

Vectors that are null or hold null or non-finite components are dropped. Vectors of other lengths are defined as padded
with zeros to the longest length, rounded up to a multiple of the number of parts (an empty vector is all zeros). Rows
that share an id are rows of their own; the first entries are taken by id (nulls last), then by components. With fewer
kept vectors than entries, codebooks have one entry for each vector. Components beyond 64 bits when scaled are computed in
Python's integers; errors beyond a long stop at its greatest value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, new_path, prepare, remove, settle

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Integers up to here have squared distances (over up to 2^20 components) that fit 64 bits.
NARROW, LONG = 1 << 20, (1 << 63) - 1
#: Sums travel as digits of so many bits, so that those of integers of any size are sums of longs.
LIMB = 30


def integers(values: np.ndarray) -> np.ndarray:
    """floor(4096 x) of finite doubles, as int64 where squared distances fit, else as Python's integers."""
    if not values.size or np.abs(values).max() < NARROW / SCALE:
        return np.floor(values * SCALE).astype(np.int64)  # a power of two scales exactly
    whole = [SCALE * n // d for n, d in map(float.as_integer_ratio, values.ravel().tolist())]
    return np.array(whole, object).reshape(values.shape)


def neighbours(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry the others by squared distance from it, then by index; and these distances."""
    apart = ((book[:, None] - book[None, :]) ** 2).sum(2)
    order = np.array([sorted((j for j in range(len(book)) if j != i), key=lambda j: (apart[i, j], j)) for i in range(len(book))], np.int64).reshape(len(book), -1)
    return order, np.take_along_axis(apart, order, 1)


def exponion(x: np.ndarray, book: np.ndarray, near: tuple[np.ndarray, np.ndarray], start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each row (ties to the lower index), its squared distance, and how many distances were computed for it."""
    order, apart = near
    distance = ((x - book[start]) ** 2).sum(1)
    best, least, radius, scanned = start.copy(), distance.copy(), 4 * distance, np.ones(len(x), np.int64)
    left = np.arange(len(x))
    for step in range(order.shape[1]):
        left = left[(apart[start[left], step] <= radius[left]).astype(bool)]  # |c_j - c| <= 2 d, squared
        if not len(left):
            break
        entry = order[start[left], step]
        found = ((x[left] - book[entry]) ** 2).sum(1)
        better = ((found < least[left]) | (found == least[left]) & (entry < best[left])).astype(bool)
        best[left[better]], least[left[better]] = entry[better], found[better]
        scanned[left] += 1
    return best, least, scanned


def limbs(total: int) -> list[int]:
    """A whole number as signed digits of LIMB bits."""
    sign, total, out = (-1 if total < 0 else 1), abs(int(total)), []
    while total:
        out.append(sign * (total & (1 << LIMB) - 1))
        total >>= LIMB
    return out


def vectors(column: pa.Array, width: int) -> np.ndarray:
    """The integers of a batch of lists, padded with zeros to the width."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    padded = np.zeros((len(sizes), width))
    if len(flat):
        padded[np.arange(width)[None, :] < sizes[:, None]] = flat
    return integers(padded)


def _pass(rows: DataFrame, books: list[np.ndarray], width: int, path: str) -> None:
    """Write rows with new codes, errors and scanned distances at the path, and a row of sums for each task."""
    names, part, entries = ["vec_id", "label", "vector"], width // PARTS, len(books[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = [neighbours(book) for book in books]
        counts, totals, last = np.zeros((PARTS, entries), np.int64), np.zeros((PARTS, entries, part), object), None
        for batch in batches:
            x, n = vectors(batch["vector"], width), batch.num_rows
            before = batch["code"].to_pylist()
            start = np.frombuffer(b"".join(before), np.uint8).reshape(n, PARTS).astype(np.int64) if before[0] is not None else np.zeros((n, PARTS), np.int64)
            codes, error, scanned = np.empty((n, PARTS), np.uint8), np.zeros(n, object), np.zeros(n, np.int64)
            for p, book in enumerate(books):
                piece = x[:, p * part : (p + 1) * part]
                entry, least, looked = exponion(piece, book, near[p], start[:, p])
                codes[:, p], scanned = entry, scanned + looked
                error = error + least
                counts[p] += np.bincount(entry, minlength=entries)
                sums = np.zeros((entries, part), piece.dtype)
                np.add.at(sums, entry, piece)
                totals[p] += sums
            error = [min(int(e), LONG) for e in error]
            last = batch.schema
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in names], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error, pa.int64()), pa.array(scanned), pa.nulls(n, SUMS)],
                names=[*names, "code", "error", "scanned", "sums"],
            )
        if last is not None:
            cells = np.concatenate([counts[:, :, None].astype(object), totals], 2).ravel()
            found = [{"cell": i, "limb": k, "total": d} for i, v in enumerate(cells) if v for k, d in enumerate(limbs(v))]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, last.field(c).type) for c in names], pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([found], SUMS)], names=[*names, "code", "error", "scanned", "sums"])

    rows.select(*names, "code").mapInArrow(run, _schema(rows)).write.parquet(path)


def _schema(rows: DataFrame) -> str:
    kinds = dict(rows.dtypes)
    return ", ".join(f"{c} {kinds[c]}" for c in ("vec_id", "label", "vector")) + ", code binary, error long, scanned long, sums array<struct<cell:int,limb:int,total:long>>"


SUMS = pa.list_(pa.struct([("cell", pa.int32()), ("limb", pa.int32()), ("total", pa.int64())]))


def _moved(stored: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Each entry at the floored mean of its parts; unused entries stay. What is collected is as large as the codebooks."""
    sums = stored.where("sums is not null").select(F.explode("sums").alias("s")).groupBy("s.cell", "s.limb").agg(F.sum("s.total").alias("total"))
    cells: dict[int, int] = {}
    for r in sums.collect():
        cells[r["cell"]] = cells.get(r["cell"], 0) + (r["total"] << LIMB * r["limb"])
    part, out = width // PARTS, []
    for p, book in enumerate(books):
        rows = []
        for e in range(len(book)):
            at = (p * len(book) + e) * (part + 1)
            n = cells.get(at, 0)
            rows.append([cells.get(at + 1 + i, 0) // n for i in range(part)] if n else [int(v) for v in book[e]])
        out.append(_array(rows, part))
    return out


def _array(rows: list[list[int]], part: int) -> np.ndarray:
    wide = any(abs(v) >= NARROW for r in rows for v in r)
    return np.array(rows, object if wide else np.int64).reshape(len(rows), part)


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for book in books for entry in book for v in entry).encode()).hexdigest()


def compress(embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, vector, code, error, scanned) of every kept vector, settled, and the codebooks of all parts."""
    spark = prepare(embeddings.sparkSession)
    kind = "array<float>" if "float" in dict(embeddings.dtypes)[vector_column] else "array<double>"
    rows = embeddings.select(F.col(id_column).alias("vec_id"), F.col(label_column).alias("label"), F.col(vector_column).cast(kind).alias("vector"))
    rows = rows.where(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    width = PARTS * -(-max(1, longest or 0) // PARTS)
    first = rows.select("vec_id", "vector").orderBy(F.asc_nulls_last("vec_id"), "vector").limit(ENTRIES).collect()
    whole = vectors(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), width)
    part = width // PARTS
    books = [_array(whole[:, p * part : (p + 1) * part].tolist(), part) for p in range(PARTS)]
    kept = rows.withColumn("code", F.lit(None).cast("binary"))
    if not first:
        return settle(kept.withColumns({"error": F.lit(0).cast("long"), "scanned": F.lit(0).cast("long")})), books
    last = None
    for turn in range(rounds + 1):
        path = new_path(spark, "codes")
        _pass(kept, books, width, path)
        stored = spark.read.schema(_schema(kept)).parquet(path)
        if turn < rounds:
            books = _moved(stored, books, width)
        kept = stored.where("sums is null").drop("sums")
        if last:
            remove(spark, last)
        last = path
    return kept, books


def codes(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256, scanned of every kept vector."""
    kept, books = compress(embeddings)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    labels = checked(settle(kept.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error"))))
    return kept.join(labels, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"), "scanned",
    )


def oracle(rounds: int = ROUNDS) -> str:
    """The same rows by full searches, in SQL: for vectors of one length that is a multiple of the number of parts."""
    floor_div = "((s - ((s % n) + n) % n) // n)"
    steps = [
        f"""kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"parts AS (SELECT r, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS x FROM kept, range({PARTS}) t(p))",
        f"book0 AS (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= {ENTRIES})",
    ]
    distance = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for turn in range(rounds + 1):
        steps.append(
            f"""near{turn} AS MATERIALIZED (SELECT r, parts.p AS p, arg_min(e, d * {ENTRIES} + e) AS e, min(d) AS d FROM (SELECT r, parts.p AS p, e, CAST({distance} AS BIGINT) AS d FROM parts JOIN book{turn} b ON parts.p = b.p) parts GROUP BY r, parts.p)"""
        )
        if turn < rounds:
            steps.append(
                f"""mean{turn} AS (SELECT p, e, list({floor_div} ORDER BY i) AS c FROM (SELECT m.p AS p, m.e AS e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n
                FROM near{turn} m JOIN parts ON parts.r = m.r AND parts.p = m.p, range(1, CAST((SELECT max(len(x)) FROM parts) AS BIGINT) + 1) t(i) GROUP BY m.p, m.e, i) GROUP BY p, e)"""
            )
            steps.append(f"book{turn + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{turn} b LEFT JOIN mean{turn} m ON b.p = m.p AND b.e = m.e)")
    return "WITH " + ",\n".join(steps) + f""",
        coded AS (SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY r),
        sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded ON kept.r = coded.r, sha"""
