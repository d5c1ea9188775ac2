"""Toxicity by maximum-scoring segments.

A token's score is the lower bound of its smoothed log-odds between toxic and other documents (a symmetric
Dirichlet prior of PRIOR pseudo-counts a class, Z standard deviations below the mean), less DRIFT, so that
text of neutral tokens drifts down. One linear scan of a document finds all maximal scoring segments (Ruzzo
and Tompa, 1999). Segment maxima of non-toxic documents follow an extreme-value law whose location grows with
the logarithm of the length; it is fitted to the training rows and standardises every segment, x = (S - a -
b ln n) / scale, so that a segment's E-value is exp(-x). The document's evidence is its largest x (at most MOST)
and the logarithm of 1 plus the sum of x over significant segments; a logistic fit on the training rows turns both
into the score.

Training rows are dealt into two folds by a hash of their ids. What the law and the logistic fit see of a fold is
scored with the tokens of the other fold, so that neither is fitted to segments that its own rows made; the model
then holds the tokens of both. If a fold lacks one of the classes, all rows are scored with the tokens of all.

Labels are learned from at most SAMPLE labelled documents in the order of a hash of their ids, from their whole
texts; a document of several labels is toxic if one of them says so, and of rows that repeat a labelled id one text
learns (the first by hash). The telling tokens of these documents are kept, the TERMS strongest at most: those of positive score, and those that occur FEW times or more with a score under -DRIFT; a token lowers a
segment by LOWEST at most, since a strongly negative one would hide what follows it. Every text is scored whole.
Null and empty texts have no segment and get the score of no evidence.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ChunkCoder, id_crc, over_batches, prepare, release, settle, valid, valid_texts, words

SAMPLE, TERMS = 20_000, 1 << 18
PRIOR, Z, DRIFT, FEW, LOWEST = 0.5, 1.0, 1.0, 5, -3.0
SIGNIFICANT, MOST = 3.0, 30.0
EULER = 0.5772156649015329


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, end, score) of all maximal scoring segments, in linear time."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[int, int, float, float]] = []  # start, end, total before, total after
    for i in np.flatnonzero(scores > 0).tolist():
        start, low, high = i, total[i], total[i + 1]
        j = len(found) - 1
        #: skip[j] is the nearest earlier segment with a smaller total before it.
        while True:
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append((start, i + 1, low, high, j))
                break
            start, low = found[j][0], found[j][2]
            up = found[j][4]
            del found[j:]
            j = up
    return [(a, b, float(y - x)) for a, b, x, y, _ in found]


@dataclass
class Model:
    scores: dict[str, float]
    location: tuple[float, float] = (0.0, 0.0)
    scale: float = 1.0
    weights: tuple[float, float, float] = (-3.0, 1.0, 0.0)

    def _learn(self, chunks: list[str]) -> list[bytes]:
        get = self.scores.get
        return [array("d", [get(w, -DRIFT) for w in words(c)]).tobytes() for c in chunks]

    def passages(self, texts: pa.Array) -> list[tuple[int, list[tuple[int, int, float]]]]:
        """The number of tokens and the segments of each text."""
        scores, at = ChunkCoder(self._learn, "f8").encode(texts)
        return [(int(j - i), segments(scores[i:j])) for i, j in zip(at[:-1], at[1:], strict=True)]

    def standard(self, score: float, n: int) -> float:
        return (score - self.location[0] - self.location[1] * math.log(n + 1)) / self.scale

    def evidence(self, texts: pa.Array) -> list[tuple[float, float, list[tuple[int, int, float]]]]:
        """For each text the largest x, that of all significant segments, and those as (start, end, x)."""
        out = []
        for n, found in self.passages(texts):
            x = [(a, b, self.standard(s, n)) for a, b, s in found]
            kept = [s for s in x if s[2] >= SIGNIFICANT]
            out.append((max([0.0, *(s[2] for s in x)]), math.log1p(sum(s[2] for s in kept)), kept))
        return out

    def score(self, best: float, total: float) -> float:
        z = self.weights[0] + self.weights[1] * min(best, MOST) + self.weights[2] * total
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple:
    """Newton steps with a small ridge; weights of 1 and the columns of x."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def _scores(counts: DataFrame) -> dict[str, float] | None:
    """The telling tokens of (token, clean, toxic) rows; None if a class is missing."""
    sums = counts.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.count_if(F.col("clean") + F.col("toxic") > 0).alias("n")).first()
    if not sums["toxic"] or not sums["clean"]:
        return None
    a, total = PRIOR, lambda c: sums[c] + PRIOR * sums["n"]
    odds = F.log((F.col("toxic") + a) / (total("toxic") - F.col("toxic"))) - F.log((F.col("clean") + a) / (total("clean") - F.col("clean")))
    bound = odds - Z * F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("clean") + a)) - DRIFT
    telling = counts.select("token", bound.alias("score"), (F.col("clean") + F.col("toxic")).alias("n")).where(f"n > 0 and (score > 0 or (n >= {FEW} and score < -{DRIFT}))")
    telling = telling.orderBy(F.desc(F.abs("score")), "token").limit(TERMS)
    return {r["token"]: max(r["score"], LOWEST) for r in telling.collect()}


def learn(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on documents joined with labels; both are expected to hold training rows only."""
    spark = prepare(documents.sparkSession)
    each = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    each = each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)).cast("int"))
    # At most `sample` rows of three numbers are broadcast, and one text for each of them is kept.
    marked = documents.where("text is not null").select("doc_id", valid("text").alias("text")).join(F.broadcast(each), "doc_id")
    marked = settle(marked.groupBy("doc_id", "toxic", "fold").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")))

    def counted(batch: pa.RecordBatch) -> dict:
        by: dict[str, list[int]] = {}
        for text, toxic, fold in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), batch["fold"].to_pylist(), strict=True):
            for w, n in Counter(words(text)).items():
                by.setdefault(w, [0, 0, 0, 0])[2 * fold + (toxic > 0)] += n
        return {"token": pa.array(list(by), pa.string())} | {c: pa.array([v[i] for v in by.values()], pa.int64()) for i, c in enumerate(("clean0", "toxic0", "clean1", "toxic1"))}

    parts = ("clean0", "toxic0", "clean1", "toxic1")
    counts = over_batches(marked, counted, "token string, " + ", ".join(f"{c} long" for c in parts)).groupBy("token").agg(*[F.sum(c).alias(c) for c in parts]).persist()
    both = _scores(counts.select("token", (F.col("clean0") + F.col("clean1")).alias("clean"), (F.col("toxic0") + F.col("toxic1")).alias("toxic")))
    folds = [_scores(counts.select("token", F.col(f"clean{i}").alias("clean"), F.col(f"toxic{i}").alias("toxic"))) for i in (0, 1)] if both is not None else []
    counts.unpersist()
    if both is None:
        release(marked)
        return Model({})
    model = Model(both)
    others = [Model(both), Model(both)] if None in folds else [Model(folds[1]), Model(folds[0])]  # a fold's tokens score the other

    def in_folds(f: Callable[[Model, pa.Array], list[tuple]], columns: list[str]) -> np.ndarray:
        """toxic and what f gives of every training row, by the model for its fold."""
        held = spark.sparkContext.broadcast(others)

        def run(batch: pa.RecordBatch) -> dict:
            found, fold = [None] * batch.num_rows, batch["fold"].to_numpy()
            for i, m in enumerate(held.value):
                at = np.flatnonzero(fold == i)
                for j, x in zip(at.tolist(), f(m, batch["text"].take(pa.array(at))), strict=True):
                    found[j] = x
            return {"toxic": batch["toxic"]} | {c: pa.array([x[i] for x in found], pa.float64()) for i, c in enumerate(columns)}

        # At most `sample` rows of three numbers.
        rows = over_batches(marked, run, "toxic int, " + ", ".join(f"{c} double" for c in columns)).collect()
        return np.array([tuple(r) for r in rows], np.float64).reshape(-1, 1 + len(columns))

    fit = in_folds(lambda m, texts: [(n, max((s[2] for s in x), default=0.0)) for n, x in m.passages(texts)], ["n", "best"])
    clean = fit[fit[:, 0] == 0]
    if len(clean) > 10:
        length = np.log(clean[:, 1] + 1)
        slope = max(0.0, float(np.cov(length, clean[:, 2], bias=True)[0, 1] / max(length.var(), 1e-9)))
        rest = clean[:, 2] - slope * length
        scale = max(0.25, float(rest.std() * math.sqrt(6) / math.pi))
        for m in (model, *others):
            m.scale, m.location = scale, (float(rest.mean() - EULER * scale), slope)
    fit = in_folds(lambda m, texts: [(min(f[0], MOST), f[1]) for f in m.evidence(texts)], ["best", "total"])
    model.weights = _logistic(fit[:, 1:], (fit[:, 0] > 0).astype(float))
    release(marked)
    return model


def trained(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learned from rows whose crc32 of the id isn't divisible by 5."""
    return learn(documents, labels.where(F.pmod(id_crc(), F.lit(5)) != 0), sample)


def score(documents: DataFrame, model: Model, columns: list[str], text: str = "text") -> DataFrame:
    """The columns, score, and the significant passages as (first word, end word, x) of every row."""
    spark = prepare(documents.sparkSession)
    held = spark.sparkContext.broadcast(model)
    wanted = documents.select(*columns, *[text] * (text not in columns))
    passage = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("x", pa.float64())])

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = held.value
        found = m.evidence(valid_texts(batch[text]))
        spans = [[{"start": a, "end": b, "x": x} for a, b, x in f[2]] for f in found]
        arrays = [batch[c] for c in columns] + [pa.array([m.score(*f[:2]) for f in found], pa.float64()), pa.array(spans, pa.list_(passage))]
        return pa.RecordBatch.from_arrays(arrays, names=[*columns, "score", "passages"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields[: len(columns)]]
    return over_batches(wanted, scored, ", ".join([*fields, "score double", "passages array<struct<start:int,end:int,x:double>>"]))
