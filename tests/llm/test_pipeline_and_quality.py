"""The pipeline against a plain run of its stages, what the fitted models reach on held-out rows, and rules that all operators share."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from postlake.llm import langid, media, minhash, orc_tokens, packing, queries, sentencepieces, sharding, tokens, toxicity

DATA = "/root/testdata"


def crc(i) -> int:
    return zlib.crc32(str(i).encode())


def groups(texts: dict[int, str]) -> set[int]:
    """The least id of each group of texts linked by a probability Jaccard of 0.8 or more, over all pairs."""
    ids = sorted(texts)
    sets = dict(zip(ids, minhash.shingle_sets(pa.array([texts[i] for i in ids])), strict=True))
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            same = texts[i] == texts[j]
            if same or len(sets[i][0]) and len(sets[j][0]) and minhash.probability_jaccard(sets[i], sets[j]) >= minhash.THRESHOLD - 1e-12:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in ids if find(i) == i}


def test_pipeline_equals_a_plain_run_of_its_stages(spark, small):
    """Rows one by one in Python: rank distances, scores of single texts, all pairs, whole-text token ids."""
    from tokenizers import Tokenizer

    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    ranker = langid.Ranker(langid.trained(docs))
    spoken = {i: t for i, t in rows.items() if ranker.predict(t)[1] > 0}
    model = toxicity.trained(docs.where(F.col("doc_id").isin(list(spoken))), labels)
    clean = {i: t for i, t in spoken.items() if model.score(*model.evidence(pa.array([t]))[0][:2]) < 0.5}
    kept = groups(clean)
    library = Tokenizer.from_file(tokens.vocabulary())
    want = {i: np.array([*library.encode(clean[i], add_special_tokens=False).ids, 1], "<u4") for i in kept}
    pieces, windows = {}, {}
    for r in corpus_pipeline.run(spark, small).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == kept and len(kept) < len(clean) <= len(spoken) <= len(rows)
    for i, found in pieces.items():
        at = 0
        for start, length, check in sorted(found):
            assert start == at and zlib.crc32(want[i][start : start + length].tobytes()) == check
            at += length
        assert at == len(want[i])
    for found in windows.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(found), sorted(found)[1:], strict=False)) and sum(n for _, n in found) <= 2048


def test_languages_of_held_out_rows(spark):
    rows = queries.op5_language_id(spark, f"{DATA}/sf0.01").where("held_out").join(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    assert len(rows) > 200 and np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97


def test_toxicity_of_held_out_rows(spark):
    marks = spark.read.parquet(f"{DATA}/sf0.1/labels.parquet").select("doc_id", "toxic").where("toxic is not null")
    rows = queries.op8_toxicity(spark, f"{DATA}/sf0.1").where("held_out").join(marks, "doc_id").select("score", "toxic").collect()
    score, toxic = np.array([r["score"] for r in rows]), np.array([r["toxic"] for r in rows]) > 0
    above = (score[toxic][:, None] > score[~toxic][None]).mean() + (score[toxic][:, None] == score[~toxic][None]).mean() / 2
    assert toxic.sum() > 50 and above > 0.9 and (score[~toxic] < 0.5).mean() > 0.97


@pytest.mark.parametrize("parts", [1, 8, 64])
def test_padding_is_small_however_rows_are_dealt(spark, parts):
    found = packing.packed(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").repartition(parts)).select("sequence_id", "sequence_tokens").distinct().collect()
    assert sum(r["sequence_tokens"] for r in found) >= 0.98 * 2048 * len(found)


@pytest.fixture(scope="module")
def broken(spark):
    """Texts of bytes that are no UTF-8, beside others."""
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(1, b"caf\xe9 au lait \xff\xfe", "fr"), (2, good.encode(), "en"), (3, good.encode() + b" \xc3", "en"), (4, b"\xf0\x9f\x92", None), (5, None, "de")]
    return spark.createDataFrame([(i, None if t is None else bytearray(t), lang) for i, t, lang in rows], "doc_id long, raw binary, lang string").withColumn("text", F.col("raw").cast("string")).cache()


def test_invalid_utf8_stops_no_operator(spark, broken):
    texts = {r["doc_id"]: None if r["raw"] is None else bytes(r["raw"]) for r in broken.collect()}
    docs = broken.drop("raw")
    fixed = {i: (t or b"").decode("utf-8", "replace") for i, t in texts.items()}
    stored = {r["doc_id"]: r for r in media.digest(media.store(docs)).collect()}
    assert {i: r["n_bytes"] for i, r in stored.items()} == {i: len(t or b"") for i, t in texts.items()}
    assert sharding.shard(docs).count() == 5
    assert langid.identify(docs, langid.learn(docs), ["doc_id", "text"]).count() == 5
    assert sentencepieces.digest(sentencepieces.encode(docs)).count() == 5
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 6)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.learn(docs, labels), ["doc_id"]).count() == 5
    near = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert near[3] == 2 and near[1] == 1
    assert sorted(r["doc_id"] for r in minhash.deduplicated(docs).select("doc_id").collect()) == [1, 2, 4, 5]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary())
    ids = {i: np.array(library.encode(t, add_special_tokens=False).ids, "<u4") for i, t in fixed.items()}
    found = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in orc_tokens.summed(orc_tokens.store(docs)).collect()}
    assert found == {i: (len(x) + 1, zlib.crc32(np.append(x, 2).astype("<u4").tobytes())) for i, x in ids.items()}
    assert {r["doc_id"]: r["doc_tokens"] for r in packing.packed(docs).collect()} == {i: len(x) + 1 for i, x in ids.items()}


def test_rows_of_one_id_are_parted_by_their_texts(spark, tmp_path):
    docs = spark.range(4000).selectExpr("cast(null as long) as doc_id", "concat('text ', id) as text").unionByName(spark.createDataFrame([(7, "seven")], "doc_id long, text string"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # the table is small
    try:
        orc_tokens.write_ids(docs, f"file://{tmp_path}/ids")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stored = spark.read.orc(f"file://{tmp_path}/ids")
    sizes = [r["n"] for r in stored.groupBy("part").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 1 and max(sizes) < 4000
    rows = orc_tokens.read_ids(spark, f"file://{tmp_path}/ids").select("doc_id", "start", F.size("ids").alias("n")).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None] * 4000 + [7] and all(a["start"] + a["n"] == b["start"] for a, b in zip(rows, rows[1:], strict=False))


def test_a_labelled_id_that_repeats_learns_once(spark):
    rows = [(i, f"bad{i % 3} word{i % 11}" if i % 4 == 0 else f"word{i % 7} other{i % 5}") for i in range(1, 200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    once, often = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(rows + [rows[3]] * 500, "doc_id long, text string")
    assert toxicity.learn(once, labels) == toxicity.learn(often, labels)


def test_boxes_at_any_depth():
    inner = media._box(b"stsz", b"\0" * 12)
    for _ in range(5000):
        inner = media._box(b"moov", inner)
    found = list(media.boxes(inner + media._box(b"free")))
    assert len(found) == 5002 and len(found[-2][0]) == 5001 and found[-1][0] == (b"free",)
