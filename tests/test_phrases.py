"""Phrases by pairs of common words: which lists are read, and the same hits and scores as over the texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from postlake.operators import index, phrases, search
from postlake.operators.phrases import Part, cover

SCHEMA = "nid long, source_name string, folder string, subject string, sender string, date timestamp, size long, to string, body string"


def term(text):
    return search.parse(text).positive[0]


def test_lists_of_a_phrase():
    common = {"of", "the"}
    assert cover(term('"of the"'), common) == [Part("of the", 1, True)]
    assert cover(term('"licensed under the"'), common) == [Part("licensed", 0), Part("under the", 2, True)]
    assert cover(term('"end of the"'), common) == [Part("end of", 1, True), Part("of the", 2, True)]
    assert cover(term('"the end"'), common) == [Part("the end", 1, True)] == cover(term('"the end"'), {"the"})
    assert cover(term('"some words"'), common) == [Part("some", 0), Part("words", 1)]
    assert cover(search.Term(("of", "th"), prefix=True), common) == [Part("of th", 1, True, True)]
    assert cover(search.Term(("end", "the"), prefix=True), common) == [Part("end", 0), Part("the", 1, begun=True)]  # "end then" isn't kept
    assert cover(search.Term(("x", "end", "of", "t"), prefix=True), common) == [Part("x", 0), Part("end of", 2, True), Part("of t", 3, True, True)]


@pytest.mark.parametrize("words", [["a"], ["a", "b", "c"], ["b", "c", "d", "e"]])
def test_no_whole_list_of_a_common_word(words):
    rng = random.Random(len(words))
    for _ in range(300):
        phrase = tuple(rng.choice("abcdefg") for _ in range(rng.randint(2, 6)))
        parts = cover(search.Term(phrase), set(words))
        assert all(p.paired for p in parts if p.token in words)
        covered = {i for p in parts for i in ((p.last - 1, p.last) if p.paired else (p.last,))}
        assert covered == set(range(len(phrase))) and all(p.token == " ".join(phrase[p.last - p.paired : p.last + 1]) for p in parts)


def mails(spark, source: str, n: int, words: list[str], seed: int):
    rng = random.Random(seed)
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    rows = [(i, source, "f", text(4), text(1), None, 1, str(i), None if i % 17 == 3 else "" if i % 17 == 4 else text(3 + i % 20)) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def prints(df):
    return df.groupBy("source_name").agg(F.sum("size").alias("size"), F.lit(1.0).alias("mtime"))


QUERIES = ['"the of"', '"of the"', '"of the red"', '"red of the house"', '"red house"', 'subject:"of the"', '"the the"', 'red -"of the"', '"house the"', '"of the of the"', '"never the"']
TYPED = ["the ho", '"of the" re', '"of the']


def test_phrases_equal_those_of_the_texts(spark, tmp_path):
    # What is common differs: "of" and "the" in the first, "red" and "house" in the second.
    a = mails(spark, "a", 90, ["of", "the"] * 8 + ["red", "house", "tree"] + [f"w{i}" for i in range(30)], 1)
    b = mails(spark, "b", 70, ["red", "house"] * 8 + ["of", "the", "thereby"] + [f"w{i}" for i in range(30)], 2)
    idx = index.Index(spark, f"file://{tmp_path}/idx", least=30)
    idx.update(a, prints(a))
    idx.update(b, prints(b))

    def holds(row, t):
        last = r"" if t.prefix else r"(?!\S)"
        return any(re.search(r"(?<!\S)" + " ".join(t.words) + last, row[c] or "") for c in t.columns if c in ("subject", "sender", "body"))

    def same(queries, typed=()):
        messages = idx.messages().collect()
        for q, live in [(q, False) for q in queries] + [(q, True) for q in typed]:
            parsed = search.parse(q, live)
            want = sorted(r["id"] for r in messages if all(holds(r, t) for t in parsed.positive) and not any(holds(r, t) for t in parsed.negative))
            assert sorted(r["id"] for r in idx.search(q, live).select("id").collect()) == want, q
        return {tuple(sorted(w)) for w in idx._pairs(search.parse('"of the"'), idx.store.current()).common.values()}

    assert len(same(QUERIES, TYPED)) == 2  # batches that disagree
    for q in ('"of the"', '"red of the house"', 'subject:"house the"'):
        scores = lambda rows: [(r["id"], round(r["score"], 9)) for r in rows.select("id", "score").collect()]
        assert scores(idx.ranked(q, limit=1000)) == scores(search.ranked(idx.messages(), q, limit=1000)), q
    less = a.where("nid % 3 != 0")
    assert idx.update(less, prints(less))["removed"] == 30
    same(QUERIES[1:4])
    idx.optimize()
    assert len(same(QUERIES[1:4], TYPED[1:2])) == 1


def test_a_phrase_of_common_words_reads_no_places_of_them(spark, tmp_path):
    a = mails(spark, "a", 120, ["of", "the", "red"], 3)
    idx = index.Index(spark, f"file://{tmp_path}/idx")
    idx.update(a, prints(a))
    q, m = search.parse('"of the"'), idx.store.current()
    plan = index.frequencies(idx.postings(), q.positive[0], "n", idx._pairs(q, m))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("token") and "of the" in plan and "Join Inner" not in plan and "places" not in plan.split("Relation")[0]
