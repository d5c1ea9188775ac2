"""Packing by Karmarkar-Karp multiway differencing.

A document's tokens are cut into full windows, which need no packing, and a rest. The rests of a task's documents
are packed in groups of GROUP, as they come. In a group, each piece starts as a partial partition of k windows of
which one holds it. The two partial partitions of the largest imbalance (largest minus smallest window) are merged,
largest windows with smallest ones, until one is left. k starts at the total divided by the capacity, rounded up,
and rises by one while a window exceeds the capacity. Rests stay whole if they fit into 1/64 more windows; if not,
those over GRAIN are cut into equal pieces and the group is packed anew: whole rests cost 2 to 4 % of padding on
the test documents, pieces of 640 or less under 2 %.

A task has TASK bytes of text at least, so that its last, half empty windows don't count, however small the files are.
Groups lie within a task, so nothing is shuffled and repeated rows make no large group; sequence ids hold the
task's number. A null text counts as empty; every document has at least its end id. Repeated rows are packed one
by one.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, valid
from .tokens import encoder, vocabulary

WINDOW, GRAIN, GROUP, END = 2048, 640, 512, 1
#: Bytes of text that a task has at least.
TASK = 4 << 20


def cuts(sizes: np.ndarray, grain: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sizes cut into equal pieces of at most the grain: the size each piece is of, its start and its length."""
    parts = -(-sizes // grain)
    of = np.repeat(np.arange(len(sizes)), parts)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = sizes[of] * nth // parts[of]
    return of, start, sizes[of] * (nth + 1) // parts[of] - start


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window 0..k-1 of each size, by multiway differencing.

    Sums are negative, so that the largest window is the first. A merge keeps only the order of its windows; the
    windows of the sizes follow from the last merge back to the first.
    """
    heap, merges = [], []
    for i in np.lexsort((np.arange(len(sizes)), -sizes)).tolist():
        sums = np.zeros(k, np.int64)
        sums[0] = -sizes[i]
        heap.append((-int(sizes[i]), len(heap), sums, i))
    heapq.heapify(heap)
    n = turn = len(heap)
    while len(heap) > 1:
        _, _, s1, a = heapq.heappop(heap)
        _, _, s2, b = heap[0]
        sums = s1 + s2[::-1]
        order = sums.argsort(kind="stable")
        sums = sums[order]
        heapq.heapreplace(heap, (int(sums[0] - sums[-1]), turn, sums, turn))
        merges.append((a, b, order))
        turn += 1
    # Sizes are the nodes below n, the merges those after them.
    windows = {heap[0][3]: np.arange(k)}
    for i in range(len(merges) - 1, -1, -1):
        a, b, order = merges[i]
        of = np.empty(k, np.int64)
        of[order] = windows.pop(n + i)
        windows[a], windows[b] = of, of[::-1]
    return np.array([windows[i][0] for i in range(n)], np.int64)


def pack(sizes: np.ndarray, capacity: int = WINDOW, k: int | None = None) -> np.ndarray | None:
    """The window of each size, none over the capacity, which no size may exceed; None if k windows are given and too few."""
    if not len(sizes):
        return np.empty(0, np.int64)
    windows = k or max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = difference(sizes, windows)
        if np.bincount(window, sizes, windows).max() <= capacity:
            return np.unique(window, return_inverse=True)[1]  # without empty windows
        if k:
            return None
        windows += 1


def arrange(sizes: np.ndarray, capacity: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of the sizes as `cuts` gives them, whole if they fit so, and the window of each."""
    of, start, length = cuts(sizes, capacity)
    least = -(-int(sizes.sum()) // capacity)
    window = pack(length, capacity, least + least // 64 if (sizes > GRAIN).any() else None)
    if window is None:
        of, start, length = cuts(sizes, GRAIN)
        window = pack(length, capacity)
    return of, start, length, window


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


def packed(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Every piece of every document, its sequence, its place there, and how many tokens the sequence holds."""
    prepare(documents.sparkSession)
    path = path or vocabulary()

    def pack_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 32
        rests: list[tuple] = []  # doc_id, start, ids, tokens of the document

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = zip(*found, strict=True) if found else [[]] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in SCHEMA.split(", ")])

        def grouped(some: list[tuple]) -> list[tuple]:
            nonlocal sequence
            of, start, length, window = arrange(np.array([len(r[2]) for r in some], np.int64))
            order = np.lexsort((start, of, window))
            filled = np.bincount(window, length).astype(np.int64)
            ends = np.cumsum(length[order])
            offset = ends - length[order] - (np.cumsum(filled) - filled)[window[order]]
            out = []
            for i, at in zip(order.tolist(), offset.tolist(), strict=True):
                doc_id, first, ids, tokens = some[of[i]]
                part = ids[start[i] : start[i] + length[i]]
                out.append((doc_id, first + int(start[i]), int(length[i]), zlib.crc32(part.tobytes()), tokens, sequence + int(window[i]), at, int(filled[window[i]])))
            sequence += len(filled)
            return out

        for batch in batches:
            ids, bounds = encoder(path).with_end(batch["text"], END)
            out = []
            for doc_id, lo, hi in zip(batch["doc_id"].to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                full = (hi - lo) // WINDOW * WINDOW
                for at in range(0, full, WINDOW):
                    out.append((doc_id, at, WINDOW, zlib.crc32(ids[lo + at : lo + at + WINDOW].tobytes()), hi - lo, sequence, 0, WINDOW))
                    sequence += 1
                if lo + full < hi:
                    rests.append((doc_id, full, ids[lo + full : hi].copy(), hi - lo))
                if len(rests) == GROUP:
                    out += grouped(rests)
                    rests = []
            yield rows(out)
        if rests:
            yield rows(grouped(rests))

    # Each task leaves a window or two half full; so tasks take TASK bytes of text at least, however the rows are dealt.
    texts = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), valid("text").alias("text")).coalesce(max(1, texts // TASK))
    return rows.mapInArrow(pack_task, SCHEMA)
