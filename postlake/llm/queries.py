"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, langid, licenses, media, minhash, orc_tokens, packing, resampling, sentencepieces, sharding, toxicity, vector_codes, warc
from .common import id_crc, prepare, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(prepare(spark), sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.store(table(prepare(spark), sf_dir, "documents")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(prepare(spark), sf_dir, "embeddings"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(prepare(spark), sf_dir, "documents")
    found = langid.identify(documents, langid.trained(documents), ["doc_id"])
    return found.select("doc_id", (F.coalesce(F.pmod(id_crc(), F.lit(3)), F.lit(0)) == 1).alias("held_out"), "lang_pred", "score")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digest(sentencepieces.encode(table(prepare(spark), sf_dir, "documents")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(prepare(spark), sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity.score(documents, toxicity.trained(documents, labels), ["doc_id"])
    held_out = F.coalesce(F.pmod(id_crc(), F.lit(5)), F.lit(1)) == 0
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))


def op9_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_tokens.summed(orc_tokens.store(table(prepare(spark), sf_dir, "documents")))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(prepare(spark), sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(prepare(spark), sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(table(prepare(spark), sf_dir, "embeddings")).drop("scanned")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_sharding, op2_media_columns, op3_license_scan, op4_embedding_dedup, op5_language_id, op6_sentencepiece, op7_packing, op8_toxicity, op9_orc_tokens, op10_minhash_dedup, op11_warc, op12_vector_codes, op13_importance_resampling)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op3_license_scan": licenses.oracle(), "op11_warc": warc.oracle(), "op12_vector_codes": vector_codes.oracle(), "op13_importance_resampling": resampling.oracle()}
