"""Language ID by rank-order profiles (Cavnar and Trenkle, 1994).

A profile is the list of the PROFILE most frequent character n-grams (one to three characters of lower-cased
words, a blank on either side of a word) in order of frequency; ties go to the smaller n-gram. A document's
profile is compared with every language's by the out-of-place distance: the sum over its n-grams of how far
their ranks are apart, PROFILE where a language lacks one. The nearest language wins, ties by name.

Profiles are learned from at most SAMPLE labelled documents, taken in the order of a hash of their ids; whole
texts are counted on the executors. A prediction sees the whole text and nothing else. Text that is null or
has no letter gives `und` with score 0, as does everything if no language was learned. The score is 1 minus
the distance divided by the largest possible one.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_crc, over_batches, prepare, valid_texts

PROFILE = 300
SAMPLE = 20_000
UNKNOWN = "und"
_SHIFT = np.uint64(21)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)), bool, 0x110000)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, packed 21 bits a character, and their counts."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.concatenate([[32], np.where(letter, c, 32)[keep], [32]]).astype(np.uint64)
    if c[1] == 32:
        c = c[1:]
    if c[-2] == 32:
        c = c[:-1]
    one = c[c != 32]
    two = c[:-1] << _SHIFT | c[1:]
    three = (two[:-1] << _SHIFT | c[2:])[c[1:-1] != 32]
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


def top(grams: np.ndarray, counts: np.ndarray, k: int = PROFILE) -> np.ndarray:
    return grams[np.lexsort((grams, -counts))[:k]]


class Ranker:
    def __init__(self, profiles: dict[str, np.ndarray]):
        self.names = sorted(profiles)
        self.grams = np.unique(np.concatenate([profiles[n] for n in self.names])) if profiles else np.empty(0, np.uint64)
        #: The last row is that of unknown n-grams.
        self.ranks = np.full((len(self.grams) + 1, len(self.names)), -1, np.int64)
        for j, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.grams, profiles[name]), j] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        grams, counts = ngrams(text)
        if not len(grams) or not self.names:
            return UNKNOWN, 0.0
        own = top(grams, counts)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        ranks = self.ranks[np.where(self.grams[at] == own, at, len(self.grams))]
        apart = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(own))[:, None])).sum(0)
        best = int(apart.argmin())
        return self.names[best], float(1 - apart[best] / (PROFILE * len(own)))


def learn(documents: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """A profile for every language of (text, lang) rows that train; documents needs doc_id, text and lang."""
    prepare(documents.sparkSession)
    usable = documents.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "text", "lang")
    order = F.xxhash64("doc_id")
    # The largest hash among the first `sample` ids: one number, so the sample itself isn't gathered.
    ids = usable.select(order.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if ids is None:
        return {}
    chosen = usable.where(order <= ids).select("text", "lang")

    def counted(batch: pa.RecordBatch) -> dict:
        by: dict[str, list] = {}
        for text, lang in zip(valid_texts(batch["text"]).to_pylist(), batch["lang"].to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        langs, grams, counts = [], [], []
        for lang, texts in by.items():
            g, n = ngrams("\n".join(texts))
            langs += [lang] * len(g)
            grams.append(g)
            counts.append(n)
        g = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        return {"lang": pa.array(langs, pa.string()), "gram": pa.array(g.astype(np.int64)), "n": pa.array(np.concatenate(counts) if counts else np.empty(0, np.int64), pa.int64())}

    totals = over_batches(chosen, counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = totals.withColumn("rank", rank).where(F.col("rank") <= PROFILE).collect()  # PROFILE rows a language
    profiles: dict[str, list] = {}
    for r in sorted(best, key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, np.uint64) for k, v in profiles.items()}


def identify(documents: DataFrame, profiles: dict[str, np.ndarray], columns: list[str], text: str = "text") -> DataFrame:
    """The columns, lang_pred and score of every row."""
    prepare(documents.sparkSession)
    ranker = Ranker(profiles)
    wanted = documents.select(*columns, *[text] * (text not in columns))

    def predicted(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [ranker.predict(t) for t in valid_texts(batch[text]).to_pylist()]
        arrays = [batch[c] for c in columns] + [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
        return pa.RecordBatch.from_arrays(arrays, names=[*columns, "lang_pred", "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields[: len(columns)]]
    return over_batches(wanted, predicted, ", ".join([*fields, "lang_pred string", "score double"]))


def trained(documents: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Learned from the rows whose crc32 of the id leaves a remainder other than 1 by 3."""
    return learn(documents.where(F.pmod(id_crc(), F.lit(3)) != 1), sample)
