"""Embedding near-dedup: Euclidean p-stable hashing of normalised vectors, then exact cosine checks.

Each of L tables quantises k Gaussian projections of the unit vector with a random offset and width W. k grows
with the logarithm of the row count, so that a bucket of unrelated vectors keeps a bounded mean size, and L
follows from k so that a pair at the threshold is missed with a chance of MISS at most (Datar et al., 2004).

Equal vectors are one node with a count. What travels to a table's bucket is a node's 8-bit code with the exact
length of its rounding error, not the vector. Buckets are compared inside tasks in blocks of at most BLOCK nodes;
a larger bucket is dealt out as pairs of blocks, so that no task holds it whole, and no pair is ever written: a
task returns, for each node with a link, how many rows it links there and the root of its local group. Rounding
errors bound each cosine from both sides; pairs that the bounds don't settle are checked on the vectors in double
precision, in a second pass over the same blocks with the nodes of such pairs only. A pair that meets in several
tables counts in the first one. Components then come from the local roots.

Vectors that are null, empty, zero, or hold null or non-finite components, and rows of null id, link with
nothing (component_id is their own id). Vectors of different lengths don't link. Rows that share an id are rows of
their own under that id: they count in n_links, and each is reached by its own links only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, checked, grouped, over_batches, prepare, runs, settle
from .components import components

WIDTH, BUCKET, BLOCK, MISS = 2.0, 256, 2048, 1e-4


def collision(distance: float, width: float = WIDTH) -> float:
    """The chance that one quantised projection is the same for two points at this distance."""
    t = width / distance
    return 1 - math.erfc(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan(n: int, threshold: float) -> tuple[int, int]:
    """Projections in a table, and tables."""
    near, far = collision(math.sqrt(2 - 2 * threshold)), collision(math.sqrt(2))
    k = max(2, math.ceil(math.log(max(2.0, n / BUCKET)) / -math.log(far)))
    return k, math.ceil(math.log(MISS) / math.log(1 - near**k))


def encoded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit codes of unit vectors behind their scale, as bytes, and a bound of each one's rounding error."""
    scale = (np.abs(unit).max(1) / 127).astype("<f4")
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - codes * scale[:, None].astype(np.float64), axis=1)
    return np.concatenate([scale[:, None].view(np.uint8), codes.view(np.uint8)], 1), np.nextafter(error.astype("<f4"), np.float32(np.inf))


def decoded(codes: np.ndarray) -> np.ndarray:
    return codes[:, 4:].view(np.int8).astype(np.float32) * codes[:, :4].copy().view("<f4")


def _compare(run: pa.Table, threshold: float, exact: bool) -> dict | None:
    """For the nodes of a run that have links: rows newly linked here, and the least node of the local group.

    The first pass takes the pairs that codes and errors settle, and marks nodes of others as doubtful; the exact
    pass takes these others.
    """
    n = run.num_rows
    if n < 2:
        return None
    bucket, pair = run["bucket"][0].as_py(), run["pair"][0].as_py()
    t, node, block = bucket >> 32, run["node"].to_numpy(), run["block"].to_numpy()
    load = np.frombuffer(b"".join(run["load"].to_pylist()), np.uint8).reshape(n, -1)
    rows, error = load[:, :8].copy().view("<i8")[:, 0], load[:, 8:12].copy().view("<f4")[:, 0]
    tags = load[:, 12 : 12 + 4 * t].copy().view("<u4")
    near_unit = decoded(load[:, 12 + 4 * t :])
    unit = np.frombuffer(b"".join(run["vec"].to_pylist()), np.float64).reshape(n, -1) if exact else None
    added, root, doubtful, any_link = np.zeros(n, np.int64), node.copy(), np.zeros(n, bool), np.zeros(n, bool)
    linked = np.zeros((n, n), bool)
    for lo in range(0, n, 256):
        part = slice(lo, lo + 256)
        about = near_unit[part] @ near_unit.T
        # |x.y - x'.y'| <= |x - x'| |y| + |x'| |y - y'|, and the products' own rounding.
        slack = error[part, None] + error[None, :] * (1 + error[part, None]) + np.float32(1e-5)
        sure, may = about >= threshold + slack, about >= threshold - slack
        open_ = may & ~sure
        near = open_ & (unit[part] @ unit.T >= threshold) if exact else sure
        near[np.arange(len(near)), np.arange(lo, lo + len(near))] = False
        if pair >> 32 != pair & 0xFFFFFFFF:
            apart = block[part, None] != block[None, :]
            near &= apart
            open_ &= apart
        if not exact:
            open_[np.arange(len(near)), np.arange(lo, lo + len(near))] = False
            doubtful[part] = open_.any(1)
        if near.any():
            any_link[part], linked[part] = near.any(1), near
            for earlier in range(t):
                near &= tags[part, earlier, None] != tags[None, :, earlier]
            added[part] = near @ rows
    if not (any_link | doubtful).any():
        return None
    while True:
        least = root.copy()
        for lo in range(0, n if any_link.any() else 0, 256):
            part = slice(lo, lo + 256)
            least[part] = np.minimum(root[part], np.where(linked[part], root[None, :], np.iinfo(np.int64).max).min(1))
        if (least == root).all():
            break
        root = least
    at = np.flatnonzero(any_link | doubtful)
    return {
        "node": pa.array(node[at]), "added": pa.array(added[at]), "root": pa.array(root[at]), "doubtful": pa.array(doubtful[at]),
        "bucket": pa.array(np.full(len(at), bucket)), "pair": pa.array(np.full(len(at), pair)), "block": pa.array(block[at]),
    }


def near_vectors(embeddings: DataFrame, threshold: float = 0.95, seed: int = 0) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    prepare(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    k, tables = plan(rows.count(), threshold)

    def projections(dim: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: B006
        if dim not in cache:
            g = np.random.default_rng([seed, dim])
            cache[dim] = g.standard_normal((dim, tables * k)), g.uniform(0, WIDTH, tables * k), g.integers(1, 2**62, k) | 1
        return cache[dim]

    def hashed(batch: pa.RecordBatch) -> dict:
        ids, vectors = batch["vec_id"], batch["embedding"].to_pylist()
        out: dict[str, list] = {c: [None] * len(vectors) for c in ("vec_key", "vec", "tags", "code")}
        by_dim: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            if v and ids[i].is_valid and None not in v:
                by_dim.setdefault(len(v), []).append(i)
        for dim, at in by_dim.items():
            x = np.array([vectors[i] for i in at], np.float64) + 0.0
            with np.errstate(all="ignore"):
                scale = np.abs(x).max(1, keepdims=True)
                y = x / scale
                y = y / np.sqrt((y * y).sum(1, keepdims=True))
            good = np.flatnonzero(np.isfinite(x).all(1) & (scale[:, 0] > 0) & np.isfinite(y).all(1))
            if not len(good):
                continue
            x, y, at = x[good], y[good], [at[i] for i in good.tolist()]
            a, b, mixer = projections(dim)
            cells = np.floor((y @ a + b) / WIDTH).astype(np.int64).reshape(len(at), tables, k)
            with np.errstate(over="ignore"):
                mixed = (cells * mixer).sum(2) + np.int64(dim * 0x9E3779B1)
            tag = ((mixed ^ (mixed >> 32)) & 0xFFFFFFFF).astype("<u4")
            codes, error = encoded(y)
            for j, i in enumerate(at):
                out["vec_key"][i] = hashlib.blake2b(x[j].tobytes(), digest_size=16).digest()
                out["vec"][i], out["tags"][i], out["code"][i] = y[j].tobytes(), tag[j].tobytes(), error[j].tobytes() + codes[j].tobytes()
        return {"vec_id": ids} | {c: pa.array(v, pa.binary()) for c, v in out.items()}

    rows = settle(over_batches(rows, hashed, "vec_id long, vec_key binary, vec binary, tags binary, code binary"))
    nodes = rows.where("vec_key is not null").groupBy("vec_key").agg(F.min("vec_id").alias("least"), F.count("*").alias("rows"), *[F.first(c).alias(c) for c in ("vec", "tags", "code")])
    nodes = settle(nodes.withColumn("node", F.monotonically_increasing_id()))

    def spread(loaded: bool) -> Callable[[pa.RecordBatch], dict]:
        """A row for each table: the node's bucket there; loaded: with its count, error, tags of earlier tables and code."""

        def run(batch: pa.RecordBatch) -> dict:
            n = batch.num_rows
            tag = np.frombuffer(b"".join(batch["tags"].to_pylist()), "<u4").reshape(n, tables).astype(np.int64)
            found = {"node": pa.array(np.repeat(batch["node"].to_numpy(), tables)), "bucket": pa.array((np.arange(tables)[None, :] << 32 | tag).ravel())}
            if loaded:
                count = batch["rows"].to_numpy().astype("<i8").tobytes()
                parts = zip(batch["code"].to_pylist(), batch["tags"].to_pylist(), strict=True)
                found["load"] = pa.array([count[8 * i : 8 * i + 8] + c[:4] + g[: 4 * t] + c[4:] for i, (c, g) in enumerate(parts) for t in range(tables)], pa.binary())
            return found

        return run

    narrow = over_batches(nodes.select("node", "tags"), spread(False), "node long, bucket long")
    wide = over_batches(nodes.select("node", "tags", "rows", "code"), spread(True), "node long, bucket long, load binary")

    def compared(exact: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for found in runs(batches, ("bucket", "pair")):
                if out := _compare(found, threshold, exact):
                    yield pa.RecordBatch.from_pydict(out)

        return run

    schema = "node long, added long, root long, doubtful boolean, bucket long, pair long, block long"
    found = settle(grouped(blocks(wide, "node", BLOCK, counted=narrow)).mapInArrow(compared(False), schema))
    again = found.where("doubtful").select("node", "bucket", "pair", "block").join(nodes.select("node", "tags", "rows", "code", "vec"), "node")

    def loaded(batch: pa.RecordBatch) -> dict:
        parts = zip(batch["bucket"].to_pylist(), batch["rows"].to_pylist(), batch["code"].to_pylist(), batch["tags"].to_pylist(), strict=True)
        load = [n.to_bytes(8, "little") + c[:4] + g[: 4 * (b >> 32)] + c[4:] for b, n, c, g in parts]
        return {c: batch[c] for c in ("node", "bucket", "pair", "block", "vec")} | {"load": pa.array(load, pa.binary())}

    again = over_batches(again, loaded, "node long, bucket long, pair long, block long, vec binary, load binary")
    links = settle(found.drop("bucket", "pair", "block").unionByName(grouped(again).mapInArrow(compared(True), schema).drop("bucket", "pair", "block")))
    counts = links.groupBy("node").agg(F.sum("added").alias("added"))
    groups = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = nodes.select("vec_key", "node", "least", "rows").join(counts, "node", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = settle(known)
    heads = settle(known.groupBy("component").agg(F.min("least").alias("component_id")))
    known = known.join(checked(heads), "component").select("vec_key", (F.coalesce("added", F.lit(0)) + F.col("rows") - 1).alias("n_links"), "component_id")
    good = rows.where("vec_key is not null").select("vec_id", "vec_key").join(known, "vec_key").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = rows.where("vec_key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
