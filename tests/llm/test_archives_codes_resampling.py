"""WARC archives, vector codes and importance resampling against brute-force versions, and on awkward tables."""

import base64
import hashlib
import math
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postlake.llm import queries, resampling, vector_codes, warc


@pytest.mark.parametrize("name", ["op11_warc", "op12_vector_codes", "op13_importance_resampling"])
def test_against_sql(spark, small, name):
    db = duckdb.connect()
    for t in ("pages", "embeddings", "documents", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = db.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, small)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


# WARC archives

PAGES = [
    (1, "http://a.example.com/x?y=1", "<p>one</p>"), (2, "https://www.b.example.com:443/", "<p>one</p>"), (3, "http://a.example.com/x?y=1", "two"), (3, "http://a.example.com/x?y=1", "two"), (3, "http://c.example.com/", "two"),
    (None, "no url at all", "<p>one</p>"), (None, None, None), (7, "", ""), (8, "http://d.example.com/é b\r\nWARC-Type: x", None), (9, "http://e.example.com/long", "word " * 300_000), (10, "//f.example.com", "WARC/1.1\r\n\r\n\r\n"),
]


def brute_pages(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) of each row, by what the docstring says."""
    out, groups = [], {}
    for i, (page, url, html) in enumerate(rows):
        groups.setdefault((html or "").encode(), []).append((page is not None, page or 0, (url or "").encode(), i))
    for payload, members in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        best = max(members)
        for there, page, _, i in members:
            first = i == best[3] or len(payload) < least
            out.append((page if there else None, len(payload), digest, "response" if first else "revisit", None if first else best[1] if best[0] else None))
    return sorted(out, key=repr)


def stored(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "k", 1, "d") for r in PAGES], "page_id long, url string, html string, key string, at long, digest string")


@pytest.mark.parametrize("least", [0, 4])
def test_pages_come_back_from_archives(spark, pages, tmp_path, least):
    path = f"file://{tmp_path}"
    captures = warc.write(pages.repartition(3), path, least)
    warc.build_index(captures, path)
    want = brute_pages(PAGES, least)
    assert stored(warc.read_records(path, warc.lookup(spark, path, warc.keys_of(pages)))) == want
    found = warc.scan(spark, f"{path}/archives", payloads=True)
    assert stored(found) == want
    texts = {(r["page_id"], r["payload_bytes"]): bytes(r["payload"]) for r in found.collect() if r["record_type"] == "response"}
    assert texts[9, 1_500_000] == b"word " * 300_000 and texts[10, 14] == b"WARC/1.1\r\n\r\n\r\n"
    assert warc.archived(pages.limit(0)).count() == 0


def test_keys_sort_by_reversed_host():
    assert warc.sort_key(b"http://user@WWW.Example.com:80/A?b#c") == "com,example,www)/A?b"
    assert warc.sort_key(b"https://example.com:8443?q") == "com,example:8443)/?q"
    assert warc.sort_key("http://x.org/é \n".encode()) == "org,x)/%C3%A9%20%0A"
    assert warc.sort_key(b"http://[::1]:80/") == "[::1])/" and warc.sort_key(None) == warc.sort_key(b"") == "" and warc.sort_key(b"plain text") == "plain%20text"


def test_a_key_of_many_blocks_and_absent_keys(spark, tmp_path):
    path = f"file://{tmp_path}"
    rows = [(i, "http://hot.example.com/", f"p{i}") for i in range(100)] + [(1000 + i, f"http://h{i}.example.com/", f"q{i}") for i in range(50)]
    captures = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), path)
    parts = warc.build_index(captures, path, block=3)
    assert parts.agg(F.sum("lines"), F.sum("blocks")).first()[1] >= 50
    ask = spark.createDataFrame([("com,example,hot)/",), ("com,example,h7)/",), ("com,example,h7)/",), ("com,example,h7)",), ("zzz",), ("",), (None,)], "key string")
    assert sorted(r["page_id"] for r in warc.lookup(spark, path, ask).collect()) == [*range(100), 1007]
    one = warc.read_records(path, warc.lookup(spark, path, ask.where("key like '%h7)/'")), payloads=True).collect()
    assert [(r["page_id"], bytes(r["payload"]), r["url"]) for r in one] == [(1007, b"q7", "http://h7.example.com/")]


def test_blocks_of_a_key_by_binary_search():
    firsts = ["a", "c", "c", "c", "f"]
    held = {"b": range(0, 1), "c": range(0, 4), "d": range(3, 4), "f": range(3, 5), "z": range(4, 5)}
    assert {k: warc.blocks_of(k, firsts) for k in held} == held


def test_orphans_are_swept_and_damage_is_seen(spark, pages, tmp_path):
    path = f"file://{tmp_path}"
    captures = warc.write(pages, path)
    (tmp_path / "archives" / "part-00000-lost.warc.gz").write_bytes(b"half a rec")
    assert warc.sweep(spark, path) == 1 and warc.sweep(spark, path) == 0
    assert stored(warc.read_records(path, captures)) == brute_pages(PAGES)
    data = warc.page_record(1, b"u", "A" * 32, 3, b"abc", 0, None, b"")[1]
    with pytest.raises(ValueError, match="doesn't match"):
        warc.page_row(data)
    with pytest.raises(ValueError, match="cut off"):
        warc.page_row(data[:-6])


def test_invalid_utf8_stays_as_it_is(spark, tmp_path):
    df = spark.sql("select 1L as page_id, cast(X'687474703A2F2F61FF' as string) as url, cast(X'41FF42' as string) as html")
    r = warc.archived(df).first()
    assert (r["payload_bytes"], r["payload_digest"]) == (3, base64.b32encode(hashlib.sha1(b"A\xffB").digest()).decode())


def test_one_row_that_stands_very_often(spark, monkeypatch):
    monkeypatch.setattr(warc, "COPIES", 16)
    rows = warc.archived(spark.range(200).selectExpr("5L as page_id", "'http://a/' as url", "'same' as html")).groupBy("record_type", "refers_to").count().collect()
    assert {(r[0], r[1], r[2]) for r in rows} == {("response", None, 1), ("revisit", 5, 199)}


# Vector codes


def brute_codes(rows, rounds=6, parts=8, entries=16):
    """(id, code, error) by full searches in Python's integers."""
    kept = [(i, v, n) for n, (i, v, _) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = parts * -(-max([1, *(len(v) for _, v, _ in kept)]) // parts)
    part = width // parts
    whole = {n: [math.floor(Fraction(x) * 4096) for x in v] + [0] * (width - len(v)) for _, v, n in kept}
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v, p: v[p * part : (p + 1) * part]
    books = [[cut(whole[n], p) for _, _, n in first] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        near = {(n, p): min((apart(cut(whole[n], p), c), e) for e, c in enumerate(books[p])) for _, _, n in kept for p in range(parts)}
        if turn < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    mine = [cut(whole[n], p) for _, _, n in kept if near[n, p][1] == e]
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)] if mine else books[p][e]
    sha = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    out = [(i, "".join(f"{near[n, p][1]:02x}" for p in range(parts)), sum(near[n, p][0] for p in range(parts)), rows[n][2]) for i, _, n in kept]
    total = {}
    for _, _, e, label in out:
        total[label] = total.get(label, 0) + e
    return sorted([(i, c, min(e, 2**63 - 1), min(total[label], 2**63 - 1), sha) for i, c, e, label in out], key=repr)


def vectors(n, length, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.normal(size=length) * spread], int(rng.integers(0, 3)) or None) for i in range(n)]


ODD = [(None, [0.5] * 16, 1), (3, None, 1), (4, [0.1, None], 1), (5, [float("nan")] * 16, 1), (6, [float("inf")] * 16, 1), (7, [], 2), (8, [0.25] * 5, None), (9, [0.0] * 16, 3), (9, [0.0] * 16, 3), (9, [-0.25] * 16, 3)]


@pytest.mark.parametrize("rows", [vectors(90, 16, 1), vectors(40, 24, 2) + ODD, vectors(5, 8, 3), vectors(60, 11, 4) + [(1000, [1e30, -1e30], None)], [(1, [0.5] * 8, 0)] * 30, ODD], ids=range(6))
def test_codes_equal_full_searches(spark, rows):
    df = spark.createDataFrame([(*r, "c", 1, "s") for r in rows], "vec_id long, embedding array<float>, label int, code string, error long, sums string").repartition(3)
    found = vector_codes.codes(df)
    wide = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    got = sorted((tuple(r) for r in found.drop("scanned").collect()), key=repr)
    assert got == brute_codes(wide)


def test_codes_of_no_vectors_and_of_doubles(spark):
    assert vector_codes.codes(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert vector_codes.codes(spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")).count() == 0
    rows = [(i, [x / 3 for x in v], g) for i, v, g in vectors(30, 8, 5)]
    got = vector_codes.codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).drop("scanned").collect()
    assert sorted(map(tuple, got), key=repr) == brute_codes(rows)


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 16), st.integers(1, 40), st.integers(0, 2**32 - 1), st.sampled_from([2, 5, 1000]))
def test_exponion_search_is_exact_and_prunes(k, n, seed, span):
    rng = np.random.default_rng(seed)
    book, x = rng.integers(-span, span, (k, 3)), rng.integers(-span, span, (n, 3))  # small spans give ties and equal entries
    best, least, scanned = vector_codes.exponion(x, book, vector_codes.neighbours(book), rng.integers(0, k, n))
    every = ((x[:, None] - book[None]) ** 2).sum(2)
    assert (best == every.argmin(1)).all() and (least == every.min(1)).all() and (scanned <= k).all()


def test_exponion_search_skips_far_entries():
    rng = np.random.default_rng(0)
    book = rng.integers(-1000, 1000, (16, 2)) * 100
    x = book[rng.integers(0, 16, 500)] + rng.integers(-50, 50, (500, 2))
    near = vector_codes.neighbours(book)
    start = ((x[:, None] - book[None]) ** 2).sum(2).argmin(1)
    assert vector_codes.exponion(x, book, near, start)[2].mean() < 2  # from the right entry hardly any other is looked at


def test_limbs():
    for v in (0, 5, -5, 2**100 + 7, -(2**64)):
        assert sum(d << vector_codes.LIMB * i for i, d in enumerate(vector_codes.limbs(v))) == v


# Importance resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_features(text, longest):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute_draw(docs, aim, longest=1, percent=10, least=20, buckets=10_000, seed=2024):
    count = lambda texts: [sum(x) for x in zip(*[np.bincount([c % buckets for c in brute_features(t, longest)[1]], minlength=buckets) for t in texts] or [[0] * buckets], strict=True)]
    s, t = count([x for _, x in docs]), count(aim)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, text in docs:
        words, found = brute_features(text, longest)
        weight = sum(gain[c % buckets] for c in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least])
    may = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {}
    for k, r in enumerate(may[: percent * len(may) // 100]):
        ranks.setdefault(tuple(map(repr, r[:4])), []).append(k + 1)
    got = []
    for r in out:
        left = ranks.get(tuple(map(repr, r[:4])), []) if r[4] else []
        got.append((*r[:4], left.pop(0) if left else None))
    return sorted(got, key=repr)


DOCS = [(i, " ".join(f"w{(i * j * j) % 37}" if j % 3 else "Été-X9_y" for j in range(15 + i % 20))) for i in range(120)]
DOCS += [(None, None), (200, ""), (201, "... ___ \x00"), (202, "A" * 5000 + " b"), (203, "日本語 テスト"), (5, DOCS[5][1]), (7, DOCS[9][1]), (None, DOCS[30][1]), (None, DOCS[30][1]), (204, "tok " * 60_000)]


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_draw_equals_brute_force(spark, longest):
    df = spark.createDataFrame([(*d, 1, 2, "p") for d in DOCS], "doc_id long, text string, score long, rank long, part string").repartition(4)
    aim = ["w1 w2 w3 w4 Été", None, "x9 w1 w2"]
    target = spark.createDataFrame([(t,) for t in aim], "text string")
    got = resampling.resample(df, target, longest=longest, percent=30)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_draw(DOCS, aim, longest, percent=30)


def test_draw_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).count() == 0
    few = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    assert [tuple(r) for r in resampling.resample(few, none).collect()] == brute_draw([(1, "one two")], [])
    bad = spark.sql("select 1L as doc_id, cast(X'41FF42' as string) as text")
    assert resampling.resample(bad, none).first()["n_features"] == 1


def test_equal_rows_have_ranks_of_their_own(spark):
    df = spark.range(300).selectExpr("cast(null as long) as doc_id", "repeat('same words ', 12) as text").repartition(8)
    ranks = [r["rank"] for r in resampling.resample(df, df.limit(0)).collect() if r["rank"] is not None]
    assert sorted(ranks) == list(range(1, 31))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aZ9 _é日\n.", max_size=70), max_size=6), st.integers(1, 4))
def test_crcs_of_runs_are_combined(texts, longest):
    found = [[] for _ in texts]
    for lo, _, _, crcs, owners in resampling.features(pa.array([t.encode() for t in texts], pa.binary()), longest):
        for c, o in zip(crcs.tolist(), owners.tolist(), strict=True):
            found[lo + o].append(c)
    assert [sorted(f) for f in found] == [sorted(brute_features(t, longest)[1]) for t in texts]


def test_shifts_are_powers_of_one_map():
    s, data = resampling.Shifts(), np.array([zlib.crc32(b"abc"), 0, 0xFFFFFFFF], np.uint32)
    for n in (0, 1, 2, 7, 300, 70_000):
        tail = bytes(n)
        assert s.apply(data[:1], np.array([n]))[0] ^ zlib.crc32(tail) == zlib.crc32(b"abc" + tail)
