"""MinHash near-dedup by ProbMinHash (Ertl, 2020).

A document's elements are its shingles of five lower-cased words, weighted by how often they occur (fewer than
five words make one shingle). Each element sends a Poisson process of its weight's rate to random registers; a
register keeps the element that arrives first, and arrivals later than all registers are not made. The share of
registers that agree estimates the probability Jaccard similarity J_P, which is the Jaccard similarity where all
weights are one. BANDS bands of ROWS registers give candidates; a pair at 0.8 is missed with a chance of 3e-6.

Equal texts are one node. Links are J_P >= 0.8, checked exactly on the shingles. Only components are wanted, so
the pairs within a bucket are never all made. In each round every bucket that still holds several components names
one pivot, and each node outside the pivot's component is checked against the one pivot it meets in most buckets;
rounds go on while they link much. Of what then still shares a bucket across components, one byte of each register
is compared inside tasks (large buckets as pairs of blocks), which gives clusters of components with promising
pairs. A cluster's nodes meet with their shingles (in pairs of blocks of bounded bytes), and the promising pairs
are checked exactly there, most alike first and only while they are in different components, so that a task
returns a forest of links and no link found by banding is lost. Documents of all lengths take this one way.

Null texts stay rows of their own; texts without words link with equal texts only. Rows that repeat an id and a
text are one document; rows of one id and several texts are several documents under that id. Rows of a null id
take part; a component all of whose ids are null has a null id.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ChunkCoder, blocks, checked, give_back, grouped, mix64, narrowed, over_batches, prepare, release, runs, settle, split_hot, valid, views, words
from .components import components

WIDTH, BANDS, ROWS, THRESHOLD = 5, 42, 6, 0.8
REGISTERS = BANDS * ROWS
#: Pairs at the threshold agree in this share of registers or more but for a chance of 4e-5; others needn't be checked.
AGREE = 0.7
#: Pivot rounds go on while they link this share of what they check, and the most of them.
WORTH, ROUNDS = 0.2, 4
#: Nodes of a block whose registers are compared, bytes of shingles in a block that is checked exactly.
BLOCK, BLOCK_BYTES = 2048, 6 << 20
#: Entries of a bucket, or partners of a pivot, that one task of a join takes.
HOT = 4096
#: Texts whose registers are filled together, and elements of theirs but for the last one's.
TOGETHER, ELEMENTS = 256, 1 << 18
#: Pairs of a node that are checked at a time, before it is looked which of the others are still apart.
TRIED = 64
#: Ids of 8 bytes that are broadcast at most.
BROADCAST_IDS = 1 << 19
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _word_hashes(chunks: list[str]) -> list[bytes]:
    return [array("Q", [xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words(c)]).tobytes() for c in chunks]


_chunks = ChunkCoder(_word_hashes, "u8")


def _hashes(w: np.ndarray, width: int) -> np.ndarray:
    """A hash of the `width` words from each place on."""
    n = max(0, len(w) - width + 1)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            h = mix64(h + w[i : i + n] + _STEP)
    return h


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.sort(h)
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    return h[first], np.diff(np.append(first, len(h)))


def shingle_sets(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct shingles of each text as 64-bit hashes, and how often each occurs."""
    w, at = _chunks.encode(texts)
    h = _hashes(w, WIDTH)
    return [_distinct(h[i : j - WIDTH + 1] if j - i >= WIDTH else _hashes(w[i:j], int(j - i)) if j > i else w[:0]) for i, j in zip(at[:-1], at[1:], strict=True)]


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    return shingle_sets(pa.array([text], pa.string()))[0]


def prob_minhash(sets: list[tuple[np.ndarray, np.ndarray]], m: int = REGISTERS) -> np.ndarray:
    """A row for each set: the element of the first arrival at each of its m registers (0 for an empty set).

    All sets advance together: in each turn every element that can still win a register makes its next arrivals.
    """
    n = np.array([len(e) for e, _ in sets], np.int64)
    arrival, held = np.full(len(sets) * m, np.inf), np.zeros(len(sets) * m, np.uint64)
    at = np.concatenate([e for e, _ in sets]) if len(sets) else np.empty(0, np.uint64)
    rate = np.concatenate([w for _, w in sets]).astype(np.float64) if len(sets) else np.empty(0)
    of, time, made = np.repeat(np.arange(len(sets)), n), np.zeros(len(at)), 0
    while len(at):
        turns = min(64, max(1, 8192 // len(at)))
        count = np.arange(made + 1, made + turns + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            drawn = mix64(at[:, None] + count[None, :] * _STEP)
            register = (mix64(drawn ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(33)) % np.uint64(m)
        times = time[:, None] + np.cumsum(-np.log(((drawn >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[:, None], 1)
        where = (of[:, None] * m + register.astype(np.int64)).ravel()
        flat = times.ravel()
        early = np.flatnonzero(flat < arrival[where])
        flat, where = flat[early], where[early]
        np.minimum.at(arrival, where, flat)
        won = flat == arrival[where]
        held[where[won]] = at[early[won] // turns]
        time, made = times[:, -1], made + turns
        active = time < arrival.reshape(-1, m).max(1)[of]
        at, rate, time, of = at[active], rate[active], time[active], of[active]
    return held.reshape(-1, m)


def together(sets: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """The sets in order, in lists of bounded length and elements."""
    some, elements = [], 0
    for one in sets:
        some.append(one)
        elements += len(one[0])
        if len(some) == TOGETHER or elements >= ELEMENTS:
            yield some
            some, elements = [], 0
    if some:
        yield some


def bands_of(held: np.ndarray) -> np.ndarray:
    """BANDS keys for each row of registers."""
    rows = held.reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2])
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            key = mix64(key * _STEP + rows[:, :, r])
    return key.view(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """J_P of two weighted sets, exactly; elements of equal weights in both are counted together."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    every = np.union1d(a[0], b[0])
    wa, wb = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
    wa[np.searchsorted(every, a[0])], wb[np.searchsorted(every, b[0])] = a[1], b[1]
    kinds, n = np.unique(wa << 32 | wb, return_counts=True)
    x, y = (kinds >> 32).astype(np.float64), (kinds & 0xFFFFFFFF).astype(np.float64)
    total = 0.0
    for i in np.flatnonzero((x > 0) & (y > 0)):
        total += n[i] / (n * np.maximum(x / x[i], y / y[i])).sum()
    return float(total)


def similarity(a: str, b: str) -> float:
    return probability_jaccard(shingles(a), shingles(b))


def sketches(documents: DataFrame) -> DataFrame:
    """doc_id, text_key, row_key, band keys, a byte of each register and the number of shingles of rows with a text.

    row_key leads back to the row: its id, or a hash of the text where that is null.
    """
    prepare(documents.sparkSession)
    rows = keyed(documents).select("doc_id", "row_key", F.unhex(F.md5("text")).alias("text_key"), "text")

    def sketch(batch: pa.RecordBatch) -> dict:
        keys = batch["text_key"].dictionary_encode()
        first = np.unique(keys.indices.to_numpy(), return_index=True)[1]  # equal texts once
        sets = shingle_sets(batch["text"].take(pa.array(first)))
        held = np.concatenate([prob_minhash([]), *(prob_minhash(some) for some in together(sets))])
        empty = pa.array([not len(e) for e, _ in sets])
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(bands_of(held).ravel()), mask=empty)
        signs = (held >> np.uint64(24)).astype(np.uint8).tobytes()
        signs = pa.array([signs[i : i + REGISTERS] for i in range(0, len(signs), REGISTERS)], pa.binary())
        n = pa.array([len(e) for e, _ in sets], pa.int64())
        return {c: batch[c] for c in ("doc_id", "row_key", "text_key")} | {"bands": bands.take(keys.indices), "signs": signs.take(keys.indices), "shingles": n.take(keys.indices)}

    return over_batches(rows, sketch, "doc_id long, row_key long, text_key binary, bands array<long>, signs binary, shingles long")


def keyed(documents: DataFrame) -> DataFrame:
    rows = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), valid("text").alias("text"))
    return rows.withColumn("row_key", F.coalesce("doc_id", F.xxhash64("text")))


def of_ids(table: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """The rows of the table with these ids; up to BROADCAST_IDS of them are broadcast, beyond that the table is shuffled."""
    return table.join(checked(ids, BROADCAST_IDS), on, "left_semi")


def packed_sets(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, elements and weights (null where all are one) of these nodes, whose texts are fetched once."""

    def packed(batch: pa.RecordBatch) -> dict:
        sets = shingle_sets(batch["text"])
        weights = [None if (w == 1).all() else w.astype("<u4").tobytes() for _, w in sets]
        return {"node": batch["node"], "elements": pa.array([e.astype("<u8").tobytes() for e, _ in sets], pa.binary()), "weights": pa.array(weights, pa.binary())}

    texts = keyed(documents).join(checked(nodes, BROADCAST_IDS), "row_key").where(F.unhex(F.md5("text")) == F.col("text_key"))
    sets = settle(over_batches(texts.select("node", "text"), packed, "node long, elements binary, weights binary"))
    return sets if sets.count() == nodes.count() else settle(sets.dropDuplicates(["node"]))  # rows that repeat id and text


def unpacked(elements: pa.Array, weights: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    pairs = zip(views(elements, "<u8"), views(weights, "<u4"), strict=True)
    return [(e, np.ones(len(e), np.int64) if w is None else w.astype(np.int64)) for e, w in pairs]


def agreeing(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """Those pairs (a, b and more) whose registers agree often enough; pairs are settled."""

    @F.pandas_udf("boolean")
    def enough(x, y):
        import pandas as pd

        p, q = (np.frombuffer(b"".join(v), np.uint8).reshape(-1, REGISTERS) for v in (x, y))
        return pd.Series((p == q).mean(1) >= AGREE)

    mine, theirs = (signs.select(F.col("node").alias(c), F.col("signs").alias(f"signs_{c}")) for c in ("a", "b"))
    mine = of_ids(mine, narrowed(settle(pairs.select("a").distinct())), "a")
    found = theirs.join(checked(pairs, BROADCAST_IDS // 4), "b").join(mine, "a")
    return found.where(enough("signs_a", "signs_b")).select(pairs.columns)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs whose shingles reach the threshold; pairs (a, b, ca, cb) are settled.

    A pivot's shingles come first, then those of its partners, one after another; a pivot of many partners is parted.
    """
    counts = narrowed(settle(pairs.groupBy("a").agg(F.count("*").alias("n"))))
    dealt, parts = split_hot(pairs, counts, "a", HOT, "b")
    dealt, parts = narrowed(settle(dealt)), narrowed(settle(parts.select("a", "part")))
    none = F.lit(None).cast("long")
    pivots = sets.join(checked(parts.withColumnRenamed("a", "node"), BROADCAST_IDS // 4), "node").select(F.col("node").alias("a"), "part", none.alias("b"), none.alias("ca"), none.alias("cb"), "elements", "weights")
    others = sets.withColumnRenamed("node", "b").join(checked(dealt, BROADCAST_IDS // 4), "b").select("a", "part", "b", "ca", "cb", "elements", "weights")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = None
        for batch in batches:
            first = batch["b"].is_null().to_numpy(zero_copy_only=False)
            sets, keep = unpacked(batch["elements"], batch["weights"]), np.zeros(batch.num_rows, bool)
            starts = [0, *np.flatnonzero(first).tolist(), batch.num_rows]
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                if lo < hi and first[lo]:
                    pivot = sets[lo][0].copy(), sets[lo][1].copy()
                    lo += 1
                for i in range(lo, hi, TRIED):
                    keep[i : min(i + TRIED, hi)] = near_ones(pivot, sets[i : min(i + TRIED, hi)])
            yield batch.filter(pa.array(keep)).select(["a", "b", "ca", "cb"])
        give_back()

    rows = pivots.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    return rows.drop("part").mapInArrow(near, "a long, b long, ca long, cb long")


def near_ones(one: tuple[np.ndarray, np.ndarray], others: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Whether each of the others' J_P with this one reaches the threshold; no set is empty.

    The mass that two normalised sets share bounds J_P from above; where all weights are one, J_P is the Jaccard
    similarity. What neither settles is computed in full.
    """
    elements, weights = (np.concatenate([x[i] for x in others]) for i in (0, 1))
    n = np.array([len(e) for e, _ in others])
    at = np.cumsum(n) - n
    place = np.minimum(np.searchsorted(one[0], elements), len(one[0]) - 1)
    hit = one[0][place] == elements
    mass = np.add.reduceat(weights, at)
    both = np.add.reduceat(hit.astype(np.int64), at)
    unit = (mass == n) & (one[1].sum() == len(one[0]))
    shared = np.add.reduceat(np.where(hit, np.minimum(one[1][place] / one[1].sum(), weights / np.repeat(mass, n)), 0.0), at)
    out = unit & (both / (len(one[0]) + n - both) >= THRESHOLD - 1e-12)
    for k in np.flatnonzero(~unit & (shared >= THRESHOLD - 1e-9)).tolist():
        out[k] = probability_jaccard(one, others[k]) >= THRESHOLD - 1e-12
    return out


def _apart(run: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Order, component, registers and blocks (-1 where all may meet) of a run's rows, the largest component last, and
    for each row where the next component begins; None for one component."""
    component = run["component"].to_numpy()
    _, group, size = np.unique(component, return_inverse=True, return_counts=True)
    if len(size) < 2:
        return None
    order = np.lexsort((group, size[group]))  # pairs within the largest component are never looked at
    signs = np.frombuffer(b"".join(run["signs"].to_pylist()), np.uint8).reshape(-1, REGISTERS)[order]
    pair, block = run["pair"][0].as_py(), run["block"].to_numpy()[order]
    ends = np.append(np.flatnonzero(np.diff(group[order])) + 1, len(group))
    return order, component[order], signs, block if pair >> 32 != pair & 0xFFFFFFFF else np.full(len(block), -1), ends[np.searchsorted(ends, np.arange(ends[-2]), side="right")]


def _promising(i: int, end: int, now: np.ndarray, signs: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Rows from end on of another component whose registers agree often enough with row i, most alike first."""
    share = np.count_nonzero(signs[end:] == signs[i], axis=1)
    near = (share >= AGREE * REGISTERS) & (now[end:] != now[i])
    if block[i] >= 0:
        near &= block[end:] != block[i]
    at = np.flatnonzero(near)
    return at[np.argsort(-share[at], kind="stable")] + end


def _clusters(run: pa.Table) -> dict | None:
    """Nodes of a bucket that agree with one of another component, and the least component of those they hang together with."""
    if (found := _apart(run)) is None:
        return None
    order, component, signs, block, ends = found
    now, active = component.copy(), np.zeros(len(order), bool)
    for i, end in enumerate(ends.tolist()):
        at = _promising(i, end, component, signs, block)
        if len(at):
            active[i] = active[at] = True
            united = np.unique(now[np.append(at, i)])
            if len(united) > 1:
                now[np.isin(now, united)] = united[0]
    return {"node": pa.array(run["node"].to_numpy()[order][active]), "component": pa.array(component[active]), "root": pa.array(now[active])} if active.any() else None


def _forest(run: pa.Table) -> dict | None:
    """Links that join the components of a run, by their shingles; never more than there are components."""
    if (found := _apart(run)) is None:
        return None
    order, component, signs, block, ends = found
    sets = unpacked(run["elements"].combine_chunks(), run["weights"].combine_chunks())
    sets = [sets[i] for i in order.tolist()]
    now, ca, cb = component.copy(), [], []
    for i, end in enumerate(ends.tolist()):
        at = _promising(i, end, now, signs, block)
        while len(at):
            some, at = at[:TRIED], at[TRIED:]
            for j in some[near_ones(sets[i], [sets[j] for j in some.tolist()])].tolist():
                if now[j] != now[i]:
                    ca.append(component[i])
                    cb.append(component[j])
                    now[now == now[j]] = now[i]
            at = at[now[at] != now[i]]
    return {"ca": pa.array(ca, pa.int64()), "cb": pa.array(cb, pa.int64())} if ca else None


def _over_runs(rows: DataFrame, f: Callable[[pa.Table], dict | None], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in map(f, runs(batches, ("bucket", "pair"))):
            if found:
                yield pa.RecordBatch.from_pydict(found)
        give_back()

    return rows.mapInArrow(run, schema)


def remaining(entries: DataFrame, signs: DataFrame, sets: DataFrame) -> DataFrame:
    """(ca, cb): links that join all components that share buckets; entries are settled."""
    dealt = blocks(entries.select("bucket", "node", "component"), "node", BLOCK).join(signs.select("node", "signs"), "node")
    found = narrowed(settle(_over_runs(grouped(dealt), _clusters, "node long, component long, root long")))
    joined = components(found.select(F.col("component").alias("a"), F.col("root").alias("b")))
    members = found.select("node", "component").distinct().join(joined.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left")
    members = members.select("node", "component", F.coalesce("root", "component").alias("bucket")).join(signs.select("node", (12 * F.col("shingles")).alias("bytes")), "node")
    dealt = blocks(narrowed(settle(members)), "node", BLOCK_BYTES, "bytes").drop("bytes")
    wide = dealt.join(signs.select("node", "signs"), "node").join(sets, "node")
    return _over_runs(grouped(wide), _forest, "ca long, cb long")


def bucket_entries(classes: DataFrame) -> DataFrame:
    """(bucket, part, parts, node, component) of nodes that share a bucket; a bucket of many entries is parted."""
    every = classes.select("node", F.explode("bands").alias("bucket"))
    shared = settle(every.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    every, parted = split_hot(every, shared, "bucket", HOT, "node")
    return settle(every.join(parted.drop("n"), ["bucket", "part"]).withColumn("component", F.col("node")))


def classified(documents: DataFrame) -> DataFrame:
    """doc_id, text_key, class_id (least id of an equal text), component_id and kept of every row with a text.

    kept marks the one (doc_id, text_key) of a component that comes first.
    """
    sketched = settle(sketches(documents))
    classes = sketched.groupBy("text_key").agg(F.min("doc_id").alias("class_id"), F.min("row_key").alias("least_key"), *[F.first(c).alias(c) for c in ("bands", "signs", "shingles")])
    classes = settle(classes.withColumn("row_key", F.coalesce("class_id", "least_key")).withColumn("node", F.monotonically_increasing_id()))
    entries = bucket_entries(classes)
    nodes = settle(entries.select("node").distinct())
    signs = settle(of_ids(classes.select("node", "row_key", "text_key", "signs", "shingles"), nodes, "node"))
    sets = packed_sets(documents, narrowed(settle(signs.select("node", "row_key", "text_key"))))
    links = []
    for turn in range(ROUNDS):
        pivot = entries.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "component")).alias("p"), F.max("parts").alias("parts"))
        pivot = narrowed(settle(pivot.select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("p.node").alias("a"), F.col("p.component").alias("ca"))))
        met = entries.join(pivot, ["bucket", "part"]).where("component != ca")
        met = met.groupBy(F.col("node").alias("b"), "a").agg(F.count("*").alias("n"), F.first("ca").alias("ca"), F.first("component").alias("cb"))
        pairs = met.groupBy("b").agg(F.max(F.struct("n", "a", "ca", "cb")).alias("p")).select("b", "p.a", "p.ca", "p.cb")
        met = narrowed(settle(pairs))
        pairs = narrowed(settle(agreeing(met, signs)))
        found = narrowed(settle(verified(pairs, sets)))
        links.append(found.select("ca", "cb"))
        joined = components(found.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        named = entries.join(checked(joined.select(F.col("node").alias("component"), F.col("component").alias("new"))), "component", "left")
        named = named.select("bucket", "part", "parts", "node", F.coalesce("new", "component").alias("component"))
        several = named.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max("parts").alias("parts")).where("x != y")
        several = narrowed(settle(several.select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))))
        last, entries = entries, narrowed(settle(named.join(several, ["bucket", "part"], "left_semi")))
        going = found.count() > WORTH * pairs.count()
        release(pivot, met, pairs, several, last)
        if not going:
            break
    links.append(narrowed(settle(remaining(entries, signs, sets))))
    groups = components(reduce(DataFrame.unionByName, links), "ca", "cb")
    release(entries, nodes, signs, sets)
    groups = groups.unionByName(groups.select(F.col("component").alias("node"), "component").distinct())
    groups = narrowed(settle(groups.join(classes.select("node", "class_id", "text_key"), "node")))
    first = F.min(F.struct(F.col("class_id").isNull().alias("none"), "class_id", "text_key")).alias("first")
    heads = narrowed(settle(groups.groupBy("component").agg(first)))
    groups = groups.join(checked(heads), "component").select("node", F.col("first.class_id").alias("component_id"), F.col("first.text_key").alias("head"), F.lit(True).alias("grouped"))
    known = classes.select("node", "text_key", "class_id").join(groups, "node", "left")
    known = known.select("text_key", "class_id", F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("class_id")).alias("component_id"), F.coalesce("head", "text_key").alias("head"))
    out = sketched.select("doc_id", "text_key").join(known, "text_key")
    return out.select("doc_id", "text_key", "class_id", "component_id", ((F.col("head") == F.col("text_key")) & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, class_id, component_id and kept of every row."""
    prepare(documents.sparkSession)
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    alone = documents.where("text is null").select(doc_id, doc_id.alias("class_id"), doc_id.alias("component_id"), F.lit(True).alias("kept"))
    return classified(documents).drop("text_key").unionByName(alone)


def deduplicated(documents: DataFrame) -> DataFrame:
    """The rows of documents (doc_id, text and any others) of which one stays for each group of near copies.

    Of rows that repeat an id and a text one stays; rows of null texts all stay.
    """
    prepare(documents.sparkSession)
    names = documents.columns
    kept = classified(documents.select("doc_id", "text")).where("kept").groupBy("doc_id", "text_key").agg(F.count("*").alias("_copies"))
    kept = settle(kept.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "_copies"))
    rows = documents.toDF(*[f"column{i}" for i in range(len(names))])
    doc_id, text = (F.col(f"column{names.index(c)}") for c in ("doc_id", "text"))
    rows = rows.withColumns({"_row": doc_id.cast("long"), "_text": F.unhex(F.md5(valid(text)))})
    rows = rows.join(kept, F.col("_row").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key")), "left")
    # Rows that stay are nearly all alone under their id and text; only the others are shuffled as a whole.
    alone, several = rows.where(text.isNull() | (F.col("_copies") == 1)), rows.where("_copies > 1").dropDuplicates(["_id", "_key"])
    return alone.unionByName(several).select(*[f"column{i}" for i in range(len(names))]).toDF(*names)
