"""A corpus pipeline: language ID, toxicity, near-duplicates, packing, each stage over all that the last one kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.llm import langid, minhash, packing, toxicity
from postlake.llm.common import new_path, prepare, remove, table


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The same columns under names that no stage uses, and the text's."""
    return docs.toDF(*[f"column{i}" for i in range(len(docs.columns))]), f"column{docs.columns.index('text')}"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no language: without a letter, or with no n-gram that a learned profile has (both score 0)."""
    prepare(spark)
    rows, text = _numbered(docs)
    found = langid.identify(rows, langid.trained(docs), rows.columns, text)
    return found.where("score > 0").select(rows.columns).toDF(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score is 0.5 or more."""
    prepare(spark)
    rows, text = _numbered(docs)
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(rows, model, rows.columns, text).where("score < 0.5").select(rows.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the least id; of rows that repeat an id and a text one."""
    prepare(spark)
    return minhash.deduplicated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("packing", pack),
]

#: Models are fitted and hashes drawn, so no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(prepare(spark), sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
