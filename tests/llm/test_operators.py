"""Each operator against a brute-force version, and on awkward tables."""

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postlake.llm import embeddings, langid, licenses, media, minhash, orc_tokens, packing, queries, sentencepieces, sharding, tokens, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
LONG = " ".join(WORDS[i * i % 10] + str(i % 97) for i in range(40_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, bucket string, node long, kept boolean, _text string, component string"
ROWS = [
    (1, "the cat sat on the mat and the dog ran", "en"), (2, "", "en"), (3, None, "en"), (None, "no id here but some words", "de"), (5, LONG, None), (6, "... !!! 123", "fr"),
    (7, "der hund und die katze sind im haus", "de"), (8, "the cat sat on the mat and the dog ran", "en"), (8, "the cat sat on the mat and the dog ran", "en"), (9, "日本語 テスト ☕ naïve", None), (10, "a", "en"),
    (11, "Licensed under the Apache License, Version 2.0.\nmany other words follow so that the text as a whole is no notice", "en"), (12, " \n\n ", "es"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "s", 1, 0.5, "b", 1, True, "t", "c") for r in ROWS], SCHEMA).cache()


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.limit(0)


def by_id(df):
    return sorted((r.asDict() for r in df.collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_permutation(n):
    p = sharding.permute(np.arange(n), n, 7)
    assert sorted(p.tolist()) == list(range(n))
    assert (sharding.permute(p, n, 7, back=True) == np.arange(n)).all()
    shard, slot = sharding.locate(n - 1, n, 4, 7)
    assert sharding.row_at(shard, slot, n, 4, 7) == n - 1


def test_sharding(spark, odd, nothing, small):
    for df in (odd, spark.read.parquet(f"{small}/documents.parquet")):
        rows = sharding.shard(df).collect()
        assert len(rows) == df.count()
        shards = {}
        for r in rows:
            shards.setdefault(r["shard"], []).append(r["slot"])
        sizes = [len(shards.get(i, [])) for i in range(16)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in shards.values())
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard(odd.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard(odd).collect()}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in sharding.shard(odd).collect()} == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in ROWS}
    assert sharding.shard(nothing).count() == 0


def test_sharding_equals_a_sort_and_a_permutation(spark):
    texts = [None if i % 7 == 0 else f"text {i % 40}" for i in range(300)] + ["again"] * 50
    docs = spark.createDataFrame([(i % 90 or None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    n, rows = len(texts), sharding.shard(docs, 5, 3).collect()
    hashes = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64("doc_id", "text").alias("h")).collect()
    keyed = sorted((r["h"] % 16, r["h"], r["doc_id"] or 0, zlib.crc32(r["t"].encode())) for r in hashes)  # 16 buckets under 4,096 rows
    want = sorted((k[2], k[3], *sharding.locate(i, n, 5, 3)) for i, k in enumerate(keyed))
    assert sorted((r["doc_id"] or 0, r["text_crc32"], r["shard"], r["slot"]) for r in rows) == want
    assert all(sharding.row_at(r["shard"], r["slot"], n, 5, 3) == r["row"] for r in rows)


def test_sharding_of_one_row_without_end(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 64)
    rows = sharding.shard(spark.range(1000).selectExpr("cast(null as bigint) as doc_id", "'x' as text")).select("row", "shard", "slot").collect()
    assert sorted(r["row"] for r in rows) == list(range(1000)) and len({(r["shard"], r["slot"]) for r in rows}) == 1000


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=50_000))
def test_media_round_trip(data):
    payload = media.payload_of(data)
    assert len(payload) % 576 == 0 and payload.startswith(data) and set(payload[len(data) :]) <= {255}
    file = media.write(payload)
    t = media.tracks(file)[0]
    assert b"".join(file[o : o + s] for o, s in zip(t["offsets"], t["sizes"], strict=True)) == payload
    assert t["codec"] == "raw " and t["ticks"] == t["duration"] == len(payload) // 576 and t["sync"].sum() == -(-len(t["sizes"]) // 12)


def test_media_tables_and_faults(spark):
    file = media.write(media.payload_of(b"x" * 576 * 200))
    assert ("moov", "trak", "mdia", "minf", "stbl", "stsz") in [tuple(k.decode() for k in p) for p, _, _ in media.boxes(file)]
    df = spark.createDataFrame([(1, bytearray(file)), (2, bytearray(file[:300])), (3, None), (4, bytearray(b""))], "id long, media binary")
    rows = {r["id"]: r for r in media.describe(df).collect()}
    assert rows[1]["samples"] == 200 and len(rows[1]["keyframes"]) == 17 and rows[1]["error"] is None
    assert rows[2]["error"] and rows[3]["codec"] is None and rows[4]["error"]
    at = file.index(b"stsz") + 8
    huge = [file[:at] + struct.pack(">II", each, 0xFFFFFFF0) + file[at + 8 :] for each in (0, 1)]
    at = file.index(b"stsc") + 12
    huge.append(file[:at] + struct.pack(">I", 0xFFFFFFFF) + file[at + 4 :])
    at = file.index(b"stss") + 12
    huge.append(file[:at] + struct.pack(">I", 0) + file[at + 4 :])
    found = media.describe(spark.createDataFrame([(bytearray(x),) for x in huge], "media binary")).collect()
    assert all(r["error"] and r["codec"] is None for r in found)


def test_media_query(odd, nothing):
    rows = media.digest(media.store(odd)).collect()
    want = []
    for i, text, _ in ROWS:
        p = media.payload_of((text or "").encode())
        want.append((i, len((text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), hashlib.sha256(media.write(p)).hexdigest()))
    got = [(r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_sha256"]) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    for r in rows:
        frames, first = r["payload_bytes"] // 576, r["media_bytes"] - r["payload_bytes"]
        assert [tuple(k) for k in r["keyframes"]] == [(first + 576 * i, 576) for i in range(0, frames, 12)]
    assert media.digest(media.store(nothing)).count() == 0


def test_licenses(spark, odd, nothing, small):
    import duckdb

    found = {r["doc_id"]: r for r in licenses.scan(odd).collect()}
    assert found[11]["licenses"] == "Apache-2.0" and found[11]["n_matches"] == 1 and found[3]["n_matches"] == 0 and found[3]["best_license"] is None
    assert licenses.scan(nothing).count() == 0
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = db.sql(licenses.oracle()).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in licenses.scan(spark.read.parquet(f"{small}/documents.parquet")).collect())


def test_licenses_with_other_openings_wrapped_or_inside_lines(spark):
    permission = next(t for _, t in licenses.TEMPLATES if t.startswith("Permission is hereby granted")).split()
    wrapped = "\n".join(" * " + " ".join(permission[i : i + 9]) for i in range(0, len(permission), 9))
    texts = ["Released under the MIT License.", f"Some tool\n\n{wrapped}\n\n" + "other words " * 300, "This page is distributed under the ISC License, see below. " + "more words here " * 50]
    texts += ["Released under the\nMIT License and also covered by CC BY-NC-SA 4.0, ok then", "intro\nLicensed under the Apache License, Version 1.1.\nLicensed under CC BY-SA 3.0.\nend of it all", "a\nLicensed under the MIT License.\nb c d e f g h i j k"]
    found = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["licenses"], r["n_matches"]) for r in found] == [("MIT", 1), ("MIT", 1), ("ISC", 1), ("CC-BY-NC-SA-4.0;MIT", 2), ("", 0), ("MIT", 1)]


def test_licenses_equal_the_sql_where_notices_are_planted(spark):
    """Notices wrapped over lines, inside lines, changed by a word, cut, repeated, side by side and tied."""
    import duckdb

    rng = np.random.default_rng(12)
    texts = [None, "", "\n\n", "word", "Licensed under the MIT License.\n", "Licensed under the MIT License.\nLicensed under the MIT License.", "x " * 300]
    for _ in range(120):
        parts = []
        for _ in range(int(rng.integers(1, 4))):
            parts += [f"w{i}" for i in rng.integers(0, 50, rng.integers(0, 30))]
            notice = licenses.TEMPLATES[rng.integers(0, len(licenses.TEMPLATES))][1].split()
            for _ in range(int(rng.integers(0, 3))):
                notice[rng.integers(0, len(notice))] = str(rng.choice(["of", "the", "other", "license"]))
            parts += notice[: len(notice) - int(rng.integers(0, 3))] * int(rng.integers(1, 3))
        for i in rng.integers(0, len(parts), rng.integers(0, 12)):
            parts[i] += "\n"
        texts.append(" ".join(parts))
    db = duckdb.connect()
    documents = pa.table({"doc_id": list(range(len(texts))), "text": texts})  # noqa: F841
    want = db.sql(licenses.oracle()).fetchall()
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    assert sum(r["n_matches"] for r in got) > 100 and got[4]["n_matches"] == 1


def test_license_bounds_prune_nothing_that_matches():
    sets = [set(licenses.template_bigrams(t)) for _, t in licenses.TEMPLATES]
    for a in sets:
        lo, hi = licenses.bounds(len(a))
        for b in sets:
            assert 2 * len(a & b) / (len(a) + len(b)) < licenses.THRESHOLD or lo - 1e-9 <= len(b) <= hi + 1e-9


def vectors(rng, n, dim=24):
    base = rng.standard_normal((n, dim))
    near = base[rng.integers(0, n, n)] + 0.12 * rng.standard_normal((n, dim))
    return [v.tolist() for v in np.concatenate([base, near, near[:10], 3.0 * base[:5]])]


@pytest.mark.parametrize("block", [2048, 8])
def test_near_vectors(spark, block, monkeypatch):
    rows = list(enumerate(vectors(np.random.default_rng(3), 60)))
    rows += [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [float("nan")] * 24), (1004, [1.0, None]), (None, rows[0][1]), (1005, [1.0, 2.0]), (1006, [2.0, 4.0])]
    monkeypatch.setattr(embeddings, "BLOCK", block)
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: {j for j, y in good if j != i and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95} for i, x in good}
    root = {i: i for i, _ in good}
    while True:
        new = {i: min([root[i], *(root[j] for j in links[i])]) for i in root}
        if new == root:
            break
        root = new
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(df).collect()}
    for i, _ in rows:
        assert got[i] == ((len(links[i]), root[i], root[i] == i) if i in links else (0, i, True))
    assert sum(map(len, links.values())) > 60
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_under_repeated_ids_and_clashing_names(spark):
    rng = np.random.default_rng(8)
    a, b = rng.standard_normal((2, 16))
    rows = [(5, a), (5, b), (5, b), (7, a + 0.01 * b), (9, b * 2.0), (None, a)]
    df = spark.createDataFrame([(i, v.tolist(), 1, 2, "p") for i, v in rows], "vec_id long, embedding array<double>, node int, bucket int, pair string")
    found = sorted(map(tuple, embeddings.near_vectors(df).collect()), key=repr)
    assert found == sorted([(5, 1, 5, True), (5, 2, 5, True), (5, 2, 5, True), (7, 1, 5, False), (9, 2, 5, False), (None, 0, None, True)], key=repr)


def test_codes_bound_cosines():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((300, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes, error = embeddings.encoded(x)
    y = embeddings.decoded(codes)
    slack = error[:, None] + error[None, :] * (1 + error[:, None]) + 1e-5
    assert (np.abs(x @ x.T - y @ y.T) <= slack).all() and slack.max() < 0.05


def test_language(spark, odd, nothing, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = langid.identify(docs, langid.trained(docs), ["doc_id", "lang"]).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.98 * len(found) and all(0 <= r["score"] <= 1 for r in found)
    rows = langid.identify(odd, langid.trained(odd), ["doc_id"]).collect()
    assert len(rows) == len(ROWS) and {r["lang_pred"] for r in rows if r["doc_id"] in (2, 3, 6, 12)} == {"und"}
    assert langid.learn(nothing) == {} and langid.identify(odd, {}, ["doc_id"]).where("lang_pred != 'und'").count() == 0


def test_language_of_held_out_rows_and_by_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    profiles = langid.trained(docs)
    found = langid.identify(docs, profiles, ["doc_id", "text", "lang"]).collect()
    held = [r for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 30 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)

    def grams(text):
        counts = {}
        for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            for n in (1, 2, 3):
                for i in range(len(word) + 3 - n):
                    g = f" {word} "[i : i + n]
                    if g.strip():
                        counts[g] = counts.get(g, 0) + 1
        return sorted(counts, key=lambda g: (-counts[g], sum(ord(c) << 21 * (len(g) - 1 - j) for j, c in enumerate(g))))[: langid.PROFILE]

    spelled = lambda g: "".join(chr(int(g) >> s & 0x1FFFFF) for s in (42, 21, 0) if int(g) >> s & 0x1FFFFF)
    ranks = {name: {spelled(g): i for i, g in enumerate(p)} for name, p in profiles.items()}
    for r in held[:25]:
        own = grams(r["text"])
        apart = {name: sum(abs(i - rank[g]) if g in rank else langid.PROFILE for i, g in enumerate(own)) for name, rank in ranks.items()}
        best = min(apart, key=lambda name: (apart[name], name))
        assert r["lang_pred"] == best and r["score"] == pytest.approx(1 - apart[best] / (langid.PROFILE * len(own)))


def test_language_ties_go_by_name(spark):
    rows = [(i, "same words here", lang) for i, lang in enumerate(["b", "a", "b", "a", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.identify(docs, langid.learn(docs), ["doc_id"]).collect()} == {"a"}


def test_ngrams_and_distance():
    grams, counts = langid.ngrams("Ab b")
    unpack = lambda g: "".join(chr(int(g) >> s & 0x1FFFFF) for s in (42, 21, 0) if int(g) >> s & 0x1FFFFF)
    assert {unpack(g): int(n) for g, n in zip(grams, counts, strict=True)} == {"a": 1, "b": 2, " a": 1, "ab": 1, "b ": 2, " b": 1, " ab": 1, "ab ": 1, " b ": 1}
    own = langid.top(grams, counts)
    assert unpack(own[0]) == "b" and langid.Ranker({"x": own}).predict("Ab b") == ("x", 1.0)


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary())
    texts = [r[1] for r in ROWS if r[1] != LONG] + ["İstanbul ΑΣ don't it's <|endoftext|> a\tb\x1cc é", "!. x .. y.,", "ﬁ Ǆ ẞ ß. naïve é ́x", "漢字。テスト 12.5,3", LONG[:5000], "Straße Ärger ÀÉÎ ÿ µm ªº ǰ ŉ Œuvre*** l'été!!! it's' 's don't. x<|endoftext|>. <|endoftext|>! au,&&& a_b _ -"]
    ids, at = tokens.encoder(tokens.vocabulary()).with_end(pa.array(texts, pa.string()), 2)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == [*library.encode(t or "", add_special_tokens=False).ids, 2]


def test_sentencepiece(odd, nothing):
    rows = sentencepieces.encode(odd).collect()
    assert len(rows) == len(ROWS) and all(r["parity"] for r in rows) and all(r["round_trip"] for r in rows)
    assert sentencepieces.digest(sentencepieces.encode(nothing)).count() == 0


def model_file(path, pieces: list[tuple[str, float, int]], kind: int, byte_fallback: bool) -> str:
    """A SentencePiece model's protobuf, written by hand."""
    field = lambda number, wire, body: bytes([*([number << 3 | wire] if number < 16 else [(number << 3 | wire) & 127 | 128, number >> 4])]) + body

    def block(number, body):
        return field(number, 2, bytes([len(body)]) + body)

    data = b"".join(block(1, block(1, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([t]))) for p, s, t in pieces)
    data += block(2, field(3, 0, bytes([kind])) + field(35, 0, bytes([byte_fallback]))) + block(3, block(1, b"identity") + field(3, 0, b"\x01") + field(4, 0, b"\x01") + field(5, 0, b"\x01"))
    path.write_bytes(data)
    return str(path)


SPECIAL = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("<mask>", 0.0, 4), ("<mask>er", 0.0, 4)]
ALPHABET = [(c, -8.0 - i * 0.137, 1) for i, c in enumerate("▁abcdersmxk<>/04169")]
JOINED = [("ab", -2.0, 1), ("▁ab", -2.1, 1), ("as", -2.2, 1), ("mask", -2.4, 1), ("ma", -2.3, 1), ("sk", -2.35, 1), ("▁a", -2.6, 1), ("<s", -2.7, 1), ("s>", -2.8, 1), ("0x", -2.9, 1)]
BYTES = [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]


@pytest.mark.parametrize("kind", [sentencepieces.UNIGRAM, sentencepieces.BPE])
@pytest.mark.parametrize("fallback", [False, True])
def test_small_models_are_rebuilt(tmp_path, kind, fallback):
    """Text that spells control, byte and user-defined pieces, and text that no piece covers."""
    import sentencepiece

    path = model_file(tmp_path / "m.model", SPECIAL + ALPHABET + JOINED + BYTES * fallback, kind, fallback)
    other, mine = sentencepiece.SentencePieceProcessor(model_file=path), sentencepieces.Rebuilt(path)
    assert mine.proto.model_type == kind and mine.proto.byte_fallback == fallback and len(mine.user) == 2
    texts = ["ab ab", "  abba  b", "a", "<s> ab </s>", "x<s>x", "<0x41>", "a<0x41>b <0x", "<mask> ab<mask>ab", "<mask>er ab <mask>err", "é ab", "ab日本ab é", "<unk>", "masked ma sk", "", "<mask><mask>", "<mask", "☕<mask>☕"]
    for text in texts:
        assert mine.encode(pa.array([text]))[0].tolist() == other.encode(text), text
    ids, at = mine.encode(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in other.encode(t)] and len(at) == len(texts) + 1


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 2047), max_size=120))
def test_packing_kernel(sizes):
    sizes = np.array(sizes, np.int64)
    of, start, length, window = packing.arrange(sizes)
    assert (np.bincount(of, length, len(sizes)) == sizes).all() and (np.bincount(window, length) <= 2048).all()
    assert all((np.diff(start[of == i]) == length[of == i][:-1]).all() for i in range(len(sizes)))
    if len(sizes):
        # Whole pieces take few windows more; windows of balanced pieces of at most 768 are 5/8 full.
        assert window.max() + 1 <= -(-int(sizes.sum()) // (2048 - 768)) + 1


def test_differencing_equals_its_plain_form():
    """The two partial partitions of largest imbalance are merged, largest with smallest; sums without lists of pieces."""
    rng = np.random.default_rng(3)
    for k in (2, 3, 5):
        sizes = rng.integers(1, 500, 20)
        parts = sorted(([int(s)] + [0] * (k - 1) for s in sizes), reverse=True)
        while len(parts) > 1:
            parts.sort(key=lambda p: max(p) - min(p), reverse=True)
            merged = sorted((a + b for a, b in zip(parts[0], reversed(parts[1]), strict=True)), reverse=True)
            parts = [*parts[2:], merged]
        mine = sorted(np.bincount(packing.difference(sizes, k), sizes, k), reverse=True)
        assert mine[0] - mine[-1] <= 2 * (parts[0][0] - parts[0][-1]) + 25 and sum(mine) == sum(parts[0])


def test_packing_of_repeated_rows_and_its_padding(spark, small):
    rows = packing.packed(spark.createDataFrame([(None, "one two three")] * 5000, "doc_id long, text string").repartition(3)).collect()
    assert len(rows) == 5000 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 5000
    found = packing.packed(spark.read.parquet(f"{small}/documents.parquet").coalesce(1)).select("sequence_id", "sequence_tokens").distinct().collect()
    assert len({r["sequence_id"] for r in found}) == len(found)
    assert sum(r["sequence_tokens"] for r in found) >= 0.97 * 2048 * len(found)


def test_differencing_is_balanced():
    sizes = np.array([8, 7, 6, 5, 4])
    assert sorted(np.bincount(packing.difference(sizes, 2), sizes)) == [14, 16]


def test_packing(odd, nothing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary())
    rows = packing.packed(odd).collect()
    spans, sequences = {}, {}
    for r in rows:
        spans.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, text, _ in ROWS:
        if i == 8:
            continue
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for start, length, crc in sorted(spans[i]):
            assert start == at and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    assert len(spans[8]) == 2
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.packed(nothing).count() == 0


def test_segments_equal_brute_force():
    def maximal(s):
        """Segments by the definition: repeatedly the best-scoring run, then left and right of it."""
        best, at = 0.0, None
        for i in range(len(s)):
            total = 0.0
            for j in range(i, len(s)):
                total += s[j]
                if total > best + 1e-9:
                    best, at = total, (i, j + 1)
        if at is None:
            return []
        return maximal(s[: at[0]]) + [(at, best)] + [((a + at[1], b + at[1]), t) for (a, b), t in maximal(s[at[1] :])]

    rng = np.random.default_rng(1)
    for _ in range(150):
        s = rng.normal(-0.2, 1, rng.integers(0, 25))
        got = toxicity.segments(s)
        assert [(a, b) for a, b, _ in got] == [x for x, _ in maximal(s)]
        assert [t for *_, t in got] == pytest.approx([t for _, t in maximal(s)])


def test_toxicity(spark, odd, nothing):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(1200):
        w = list(rng.choice(vocabulary, rng.integers(5, 80)))
        if toxic := int(rng.random() < 0.2):
            for _ in range(3):
                w.insert(rng.integers(0, len(w)), f"bad{rng.integers(0, 8)}")
        rows.append((i, " ".join(w)))
        marks.append((i, toxic))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.trained(docs, labels)
    truth = dict(marks)
    found = [r for r in toxicity.score(docs, model, ["doc_id"]).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(r["score"] >= 0.5) == truth[r["doc_id"]] for r in found]) >= 0.98
    scored = toxicity.score(odd, model, ["doc_id"]).collect()
    assert len(scored) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.score(odd, toxicity.trained(nothing, labels.limit(0)), ["doc_id"]).where("score >= 0.5").count() == 0
    assert toxicity.score(odd, toxicity.trained(nothing.select("doc_id", "text"), labels), ["doc_id"]).where("score >= 0.5").count() == 0
    for r in toxicity.score(docs, model, ["doc_id", "text"]).limit(60).collect():  # by the definition, one step after another
        s = [model.scores.get(w, -toxicity.DRIFT) for w in toxicity.words(r["text"])]
        x = [(t - model.location[0] - model.location[1] * np.log(len(s) + 1)) / model.scale for *_, t in toxicity.segments(np.array(s))]
        best, total = max([0.0, *x]), np.log1p(sum(v for v in x if v >= toxicity.SIGNIFICANT))
        z = model.weights[0] + model.weights[1] * min(best, toxicity.MOST) + model.weights[2] * total
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -40, 40)))) and len(r["passages"]) == sum(v >= toxicity.SIGNIFICANT for v in x)


def test_all_telling_tokens_are_kept(spark):
    """Far more telling tokens than any cap that a table of fixed size would set."""
    docs = [(i, " ".join(f"{'bad' if i % 2 else 'good'}{j}" for j in range(i // 2 % 4 * 30_000, i // 2 % 4 * 30_000 + 30_000)) ) for i in range(80)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.learn(frame, spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int"))
    assert len([t for t, v in model.scores.items() if v > 0]) == 120_000


def test_orc(spark, odd, nothing):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary())
    rows = sorted((r.asDict() for r in orc_tokens.summed(orc_tokens.store(odd.repartition(4))).collect()), key=lambda r: r["start"])
    at, ids = 0, [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    texts = {i: t for i, t, _ in ROWS}
    assert ids == sorted(ids)
    for r in rows:
        want = np.array([*library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)
    assert orc_tokens.summed(orc_tokens.store(nothing)).count() == 0


def test_orc_files_are_indexed(spark, small, tmp_path):
    import glob

    from pyarrow import orc

    orc_tokens.write_ids(spark.read.parquet(f"{small}/documents.parquet"), f"file://{tmp_path}/ids")
    found = spark.read.orc(f"file://{tmp_path}/ids").where("doc_id = 17")
    assert found.count() == 1 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,17)]" in found._jdf.queryExecution().toString()
    files = glob.glob(f"{tmp_path}/ids/*.orc")
    assert all(orc.ORCFile(f).nstripes >= 1 for f in files)
    # Row indexes and Bloom filters are streams of the stripes; Hive's reader lists them.
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f"file://{files[0]}"), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getRowIndexStride() == 1000 and reader.getStripes().get(0).getIndexLength() > 0
    data = open(files[0], "rb").read()
    assert orc_tokens.OPTIONS["orc.bloom.filter.columns"] == "doc_id" and reader.getSchema().toString().startswith("struct<part:int,doc_id:bigint")
    plain = spark.read.schema("part int, doc_id long, before long, ids array<int>").orc(f"file://{tmp_path}/ids")
    plain.write.option("orc.create.index", "true").option("compression", "zstd").orc(f"file://{tmp_path}/without")
    index = lambda folder: sum(s.getIndexLength() for f in glob.glob(f"{tmp_path}/{folder}/*.orc") for s in jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f"file://{f}"), jvm.org.apache.orc.OrcFile.readerOptions(conf)).getStripes())
    assert len(data) > 0 and index("ids") > 1.2 * index("without")  # the filters' bytes


def test_probability_jaccard_and_its_estimate():
    rng = np.random.default_rng(2)
    for _ in range(20):
        e = rng.integers(0, 2**63, 300).astype(np.uint64)
        a, b = (np.sort(e[:240]), rng.integers(1, 4, 240)), (np.sort(e[60:]), rng.integers(1, 4, 240))
        wa, wb = dict(zip(a[0].tolist(), a[1].tolist(), strict=True)), dict(zip(b[0].tolist(), b[1].tolist(), strict=True))
        every = set(wa) | set(wb)
        exact = sum(1 / sum(max(wa.get(y, 0) / wa[x], wb.get(y, 0) / wb[x]) for y in every) for x in set(wa) & set(wb))
        assert minhash.probability_jaccard(a, b) == pytest.approx(exact)
        m = 4096
        x, y = minhash.prob_minhash([a, b], m)
        assert np.mean(x == y) == pytest.approx(exact, abs=0.04)
        assert (minhash.prob_minhash([b], m)[0] == y).all()


@pytest.mark.parametrize(("rounds", "block", "size", "hot"), [(0, 8, 6 << 20, 4096), (0, 2048, 4000, 3), (6, 2048, 6 << 20, 2)])
def test_near_duplicates(spark, rounds, block, size, hot, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", size)
    monkeypatch.setattr(minhash, "HOT", hot)
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(25):
        w = list(rng.choice(vocabulary, 150))
        for c in range(int(rng.integers(1, 8))):
            v = list(w)
            for _ in range(int(rng.integers(0, 6))):
                v[rng.integers(0, len(v))] = "x" + str(rng.integers(0, 999))
            rows.append((len(rows), " ".join(v)))
    rows += [(len(rows) + i, rows[i][1]) for i in range(5)]
    line = " ".join(vocabulary[:12]) + "\n"
    for _ in range(12):  # a line that repeats weighs most of the document
        rows.append((len(rows), line * int(rng.integers(6, 30)) + " ".join(rng.choice(vocabulary, int(rng.integers(5, 80))))))
    monkeypatch.setattr(minhash, "ROUNDS", rounds)
    sets = [minhash.shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if minhash.probability_jaccard(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i]["component_id"] for i in got} == {i: find(i) for i in range(len(rows))}
    assert all(got[i]["kept"] == (find(i) == i) for i in got)


def test_near_ones_equal_the_exact_check():
    rng = np.random.default_rng(6)
    for most in (2, 4):
        sets = [(np.sort(rng.choice(60, n, False)).astype(np.uint64), rng.integers(1, most, n)) for n in rng.integers(40, 60, 40)]
        for one in sets[:10]:
            assert minhash.near_ones(one, sets).tolist() == [minhash.probability_jaccard(one, x) >= minhash.THRESHOLD - 1e-12 for x in sets]


def test_near_duplicates_under_repeated_ids(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(200)) for c in "ab")
    near = a + " more"
    rows = [(8, a), (8, b), (8, b), (9, near), (10, near), (None, b), (None, "alone without id here"), (None, "alone without id here"), (11, None), (11, None)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, node int")
    found = {(r["doc_id"], r["class_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert found == {(8, 8, 8, True), (9, 9, 8, False), (10, 9, 8, False), (None, 8, 8, False), (None, None, None, True), (11, 11, 11, True)}
    left = sorted((r["doc_id"], r["text"]) for r in minhash.deduplicated(docs).where("doc_id is not null and text is not null").collect())
    assert left == [(8, a), (8, b)]
    assert minhash.deduplicated(docs).where("doc_id is null").count() == 1 and minhash.deduplicated(docs).where("text is null").count() == 2
    assert minhash.deduplicated(docs).columns == docs.columns


def test_long_near_copies_are_one_group(spark):
    """Documents of thousands of shingles take the same way as short ones."""
    words = [f"w{i}" for i in range(6000)]
    rows = [(i, " ".join([*words[:i * 40], *[f"x{i}_{j}" for j in range(40)], *words[i * 40 + 40 :]])) for i in range(12)]
    rows += [(100, " ".join(f"z{i}" for i in range(6000)))]
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == dict.fromkeys(range(12), 0) | {100: 100}


def test_near_duplicates_of_the_test_table_against_all_pairs(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    sets = {r["doc_id"]: s for r, s in zip(rows, minhash.shingle_sets(pa.array([r["text"] for r in rows])), strict=True) if len(s[0])}
    ids, links = np.array(list(sets)), 0
    root = {i: i for i in ids.tolist()}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, one in sets.items():
        for j in ids[minhash.near_ones(one, list(sets.values()))].tolist():
            if j > i:
                links += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert links > 50 and {i: got[i] for i in root} == {i: find(i) for i in root}


def test_near_vectors_of_the_test_table_against_all_pairs(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = table.select("vec_id", "embedding").collect()
    x = np.array([r["embedding"] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    want = dict(zip((r["vec_id"] for r in rows), (near.sum(1) - 1).tolist(), strict=True))
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_vectors(table).collect()}
    found, all_ = sum(got.values()), sum(want.values())
    assert all(got[i] <= want[i] for i in got) and found >= 0.999 * all_


def test_near_duplicates_of_awkward_rows(odd, nothing):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == len(ROWS)
    found = {r["doc_id"]: r["component_id"] for r in rows}
    assert found[8] == 1 and found[3] == 3 and found[None] is None and found[2] == 2
    assert minhash.near_duplicates(nothing).count() == 0


def test_pipeline(spark, odd, nothing, small):
    import corpus_pipeline as p

    docs = odd
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == odd.columns
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} >= {1, 7} and docs.where("doc_id in (2, 3, 6, 8, 12)").count() == 0
    foreign = spark.createDataFrame([(1, "日本語", None)], "doc_id long, text string, lang string")
    assert p.language(spark, foreign.unionByName(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")), small).where("text = '日本語'").count() == 0
    empty = nothing
    for _, stage in p.STAGES:
        empty = stage(spark, empty, small)
    assert empty.count() == 0
    assert p.run(spark, small).select(F.sum("length")).first()[0] > 0
    assert len(queries.queries()) == 13


def test_license_windows_among_many_repeats(spark):
    """A text full of one word pair of a template: its runs are found, and the work grows with the text alone."""
    name, text = max(licenses.TEMPLATES, key=lambda t: len(t[1]))
    pair = licenses.template_bigrams(text)[0]
    words = " ".join(re.sub(r"[\W_]+", " ", text.lower()).split())
    many = f"{pair} x " * 4000
    docs = spark.createDataFrame([(1, many), (2, f"{many}{words} x {many}"), (3, " x ".join(licenses.template_bigrams(text)) + " x " + many)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_matches"], r["licenses"]) for r in licenses.scan(docs).collect()}
    assert got == {1: (0, ""), 2: (1, name), 3: (0, "")}


def test_differencing_merges_as_lists_of_sizes_do():
    def plain(sizes, k):
        heap = [(-s, t, [s] + [0] * (k - 1), [[i]] + [[] for _ in range(k - 1)]) for t, (s, i) in enumerate(sorted(((s, i) for i, s in enumerate(sizes)), key=lambda x: (-x[0], x[1])))]
        turn = len(heap)
        while len(heap) > 1:
            heap.sort(key=lambda x: x[:2])
            (_, _, s1, m1), (_, _, s2, m2) = heap[:2]
            both = sorted(zip([a + b for a, b in zip(s1, s2[::-1], strict=True)], [a + b for a, b in zip(m1, m2[::-1], strict=True)], strict=True), key=lambda x: -x[0])
            heap = [*heap[2:], (both[-1][0] - both[0][0], turn, [x[0] for x in both], [x[1] for x in both])]
            turn += 1
        return {i: w for w, m in enumerate(heap[0][3]) for i in m}

    rng = np.random.default_rng(3)
    for n, k, most in ((1, 1, 9), (1, 4, 9), (9, 2, 3), (40, 7, 2048), (60, 20, 5)):
        sizes = rng.integers(1, most, n)
        assert dict(enumerate(packing.difference(sizes, k).tolist())) == plain(sizes.tolist(), k)


def test_decoding_joins_pieces_that_hold_blanks_and_markers_of_bytes():
    model = sentencepieces.rebuilt(sentencepieces.model_path())
    assert not any(sentencepieces.MARK.encode() in b for b in model.bytes)
    assert model.joined([b" a", b" b", b"\xe2", b"\x96", b"\x81", b"c", b"\xe2", b" d"]) == "a b c� d"
