"""The index as snapshots: what a removal, a compaction or a run that breaks off anywhere leaves; blocks of the dictionary; the command."""

import sqlite3
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from postlake import __main__ as command
from postlake.functions import text as T
from postlake.operators import index, search, snapshots

WORDS = "alpha beta gamma delta epsilon zeta eta theta".split()
SCHEMA = "nid long, source_name string, folder string, subject string, sender string, date timestamp, size long, to string, body string"


def rows_of(spark, source: str, n: int, first: int = 0):
    def body(i):
        return " ".join([f"only{source}", "common"] + ["rare"] * (i % 40 == 7) + [WORDS[(i * j) % 8] for j in range(1, 4 + i % 9)] + ["common"] * (i % 13 == 0) * 5)

    return spark.createDataFrame([(i, source, "f", f"s{i}", "x", None, 1, f"{i}", body(i)) for i in range(first, first + n)], SCHEMA)


def prints(df):
    return df.groupBy("source_name").agg(F.sum("size").alias("size"), F.lit(1.0).alias("mtime"))


def found(idx, query):
    return idx.search(query).count()


def same_as_texts(idx, query, limit=10):
    """Rows and scores equal those of a search over the texts themselves."""
    got = [(r["id"], round(r["score"], 9)) for r in idx.ranked(query, limit=limit).collect()]
    want = [(r["id"], round(r["score"], 9)) for r in search.ranked(idx.messages(), query, limit=limit).collect()]
    assert got == want and got
    return got


def test_a_removed_source_takes_no_other_along(spark, tmp_path):
    a, b, c = rows_of(spark, "a", 30), rows_of(spark, "b", 20), rows_of(spark, "c", 10)
    idx = index.Index(spark, f"file://{tmp_path}/idx")
    idx.update(a, prints(a))
    idx.update(b, prints(b))
    idx.optimize()
    assert idx.remove("b") == 20 and found(idx, "onlya") == 30 and found(idx, "onlyb") == 0
    idx.update(c, prints(c))
    idx.update(a, prints(a))
    assert found(idx, "onlya") == 30 and found(idx, "onlyc") == 10 and found(idx, "common") == 40
    assert [r["source_name"] for r in idx.sources().collect()] == ["a", "c"]
    assert idx.update(b, prints(b)) == {"added": 20, "kept": 0, "removed": 0} and found(idx, "onlyb") == 20
    same_as_texts(idx, "common alpha")


class Broken(Exception):
    pass


@pytest.mark.parametrize("what", ["update", "remove", "optimize"])
def test_a_run_that_breaks_off_at_any_step_changes_nothing(spark, tmp_path, monkeypatch, what):
    a, b = rows_of(spark, "a", 12), rows_of(spark, "b", 8)
    more = rows_of(spark, "a", 10, 4)
    idx = index.Index(spark, f"file://{tmp_path}/idx")
    idx.update(a, prints(a))
    idx.update(b, prints(b))
    run = {"update": lambda: idx.update(more, prints(more)), "remove": lambda: idx.remove("a"), "optimize": idx.optimize}[what]
    whole, publish, left = snapshots.Store.write, snapshots.Store.commit, [0]

    def spent(f):
        def step(self, *args):
            if left[0] == 0:
                raise Broken
            left[0] -= 1
            return f(self, *args)

        return step

    monkeypatch.setattr(snapshots.Store, "write", spent(whole))
    monkeypatch.setattr(snapshots.Store, "commit", spent(publish))
    steps = 0
    while True:
        left[0] = steps
        before = idx.store.current().version
        try:
            run()
            break
        except Broken:
            assert idx.store.current().version == before
            fresh = index.Index(spark, f"file://{tmp_path}/idx")
            assert (found(fresh, "onlya"), found(fresh, "onlyb"), fresh.messages().count()) == (12, 8, 20)
            steps += 1
    assert steps >= 3
    monkeypatch.undo()
    expected = {"update": (10, 8), "remove": (0, 8), "optimize": (12, 8)}[what]
    assert (found(idx, "onlya"), found(idx, "onlyb")) == expected
    idx.store.vacuum(1)
    m = idx.store.current()
    on_disk = {(t.name, s.name) for t in (tmp_path / "idx").iterdir() if t.name != "manifests" for s in t.iterdir() if s.is_dir()}
    assert on_disk == {(t, s) for t, names in m.segments.items() for s in names}  # nothing of broken runs stays
    assert (found(idx, "onlya"), found(idx, "onlyb")) == expected


def test_readers_keep_their_snapshot_and_writers_dont_meet(spark, tmp_path):
    a, b = rows_of(spark, "a", 10), rows_of(spark, "b", 5)
    idx = index.Index(spark, f"file://{tmp_path}/idx")
    idx.update(a, prints(a))
    before = idx.messages()
    idx.update(b, prints(b))
    assert before.count() == 10 and idx.messages().count() == 15
    old = idx.store.current()
    idx.remove("b")
    with pytest.raises(RuntimeError, match="another writer"):
        idx.store.commit(old)
    assert idx.messages().count() == 10
    idx.clear()
    assert idx.messages() is None and idx.store.current().batch >= 3
    idx.update(a, prints(a))
    assert found(idx, "onlya") == 10


def test_unreadable_messages_remove_nothing(spark, tmp_path):
    a, b = rows_of(spark, "a", 6), rows_of(spark, "b", 4)
    both = a.unionByName(b).withColumn("unread", F.lit(False))
    idx = index.Index(spark, f"file://{tmp_path}/idx")
    idx.update(both, prints(both))
    # One message of a can't be opened, and one each of a and b is gone.
    again = both.where("not (source_name = 'a' and nid = 5) and not (source_name = 'b' and nid = 3)").withColumn("unread", F.expr("source_name = 'a' and nid = 0"))
    assert idx.update(again, prints(again)) == {"added": 0, "kept": 8 + 1, "removed": 1}
    assert found(idx, "onlya") == 6 and found(idx, "onlyb") == 3
    assert {r["source_name"]: (r["complete"], r["messages"]) for r in idx.sources().collect()} == {"a": (False, 6), "b": (True, 3)}


def test_the_dictionary_counts_exactly(spark, tmp_path):
    a = rows_of(spark, "a", 400)
    idx = index.Index(spark, f"file://{tmp_path}/idx", block=16)
    idx.update(a, prints(a))
    less = a.where("nid % 3 != 0")
    idx.update(less, prints(less))
    idx.update(a.where("nid % 5 = 0"), prints(a), force=True, complete=False)

    def counted():
        texts = idx.messages().select("id", F.explode(F.array_distinct(F.concat(*[T.tokens(F.col(c)) for c in ("subject", "sender", "body")]))).alias("token"))
        return {r["token"]: r["df"] for r in idx.terms().collect()}, {r["token"]: r["n"] for r in texts.groupBy("token").agg(F.count("*").alias("n")).collect()}

    got, want = counted()
    assert got == want
    assert {r["token"] for r in idx.terms("ze").collect()} == {"zeta"}
    for q in ("common", "rare", "subject:s7", "body:common sender:x", "alpha beta -rare", "absent"):
        assert [r["id"] for r in idx.ranked(q).collect()] == [r["id"] for r in search.ranked(idx.messages(), q).collect()]
    idx.optimize()
    got, want = counted()
    assert got == want
    same_as_texts(idx, "common rare")


def test_postings_are_runs_of_messages(spark, tmp_path):
    a = rows_of(spark, "a", 300).withColumns({"attachments": F.when(F.col("nid") % 3 == 0, F.concat(F.lit("common "), "body")), "att_names": F.when(F.col("nid") % 5 < 3, F.lit("common beta"))})
    idx = index.Index(spark, f"file://{tmp_path}/idx", block=32)
    idx.update(a.where("nid < 250"), prints(a))
    idx.update(a, prints(a))
    m = idx.store.current()
    of = dict(idx.store.read("messages", m).select("num", "id").collect())
    texts, kept = idx.messages(), ("token", "id", "f", "cols", "places")
    plain = lambda rows, name: sorted((r["token"], name(r["id"]), r["f"], r["cols"], sorted(r["places"])) for r in rows.select(*kept).collect())
    assert len(of) == 300 and plain(idx.postings(), of.get) == plain(index.postings(texts), str)
    words = [r["token"] for r in idx.store.read("common", m).where("token is not null").distinct().collect()]
    assert words and {r["token"] for r in idx.store.read("pairs", m).collect()} <= {r["token"] for r in index.postings(texts, common=words).collect()}
    # A frequent word is a row for about 32 messages, not for each; a rare one is a row for each portion at most.
    files = len(idx.store.read("postings", m).inputFiles())
    rows = {r["token"]: r["count"] for r in idx.store.read("postings", m).groupBy("token").count().collect()}
    assert rows["common"] <= 300 / 16 + files and rows["rare"] <= files
    att = {r["token"]: (r["n"], r["att"]) for r in idx.store.read("terms", m).groupBy("token").agg(F.sum("n").alias("n"), F.sum("att").alias("att")).collect()}
    assert att["common"] == (300, sum(i % 3 == 0 or i % 5 < 3 for i in range(300)))
    sums = lambda rows: {r["token"]: r["n"] for r in rows.collect()}
    before = sums(idx.occurrences("att_names"))
    assert before == {"common": 180, "beta": 180}
    idx.update(a.where("nid % 5 != 0"), prints(a))
    assert sums(idx.occurrences("att_names")) == {"common": 120, "beta": 120}


def test_blocks_under_the_kth_score_are_skipped(spark, tmp_path, monkeypatch):
    rows = spark.range(4000).selectExpr("id as nid", "'a' as source_name", "'f' as folder", "concat('s', id) as subject", "'' as sender", "cast(null as timestamp) as date", "1L as size", "'' as to", "concat(repeat('common ', if(id % 997 = 5, 9, 1)), repeat('filler ', 20 + cast(id % 7 as int)), if(id % 2 = 0, 'even', 'odd')) as body")
    idx = index.Index(spark, f"file://{tmp_path}/idx", block=8)
    idx.update(rows.where("nid < 3000"), prints(rows))
    idx.update(rows, prints(rows))
    monkeypatch.setattr(index, "FIRST", 8)
    m = idx.store.current()
    for query, k, most in (("common", 4, 40), ("common odd", 3, 40), ("common even filler", 3, 400)):
        blocks = index.Blocks(idx, m, search.parse(query))
        kept, n, total = blocks.kept(k)
        assert kept.count() == n <= most < total, (query, n, total)
        same_as_texts(idx, query, k)
    for pushed in (0, 1 << 20):  # by a join, and by bounds of ids
        monkeypatch.setattr(index, "PUSHED", pushed)
        same_as_texts(idx, "common odd in:f", 12)
    same_as_texts(idx, "filler", 3000)  # more than any block


def test_combining_marks_belong_to_their_letters(spark):
    words = ["résumé x", "aͅb", "́", "ẹ́té", "naïve", "Ångström", "क्ष"]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x)")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    db.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(words)))
    want = [[r[0] for r in db.execute("SELECT term FROM v WHERE doc = ? ORDER BY offset", (i,))] for i in range(len(words))]
    got = spark.createDataFrame(list(enumerate(words)), "id long, x string").orderBy("id").select(T.tokens(F.col("x")).alias("t")).collect()
    assert [r["t"] for r in got] == want and want[0] == ["resume", "x"]
    assert search.parse("résumé").positive[0].words == ("resume",)


def mail(i: int) -> bytes:
    m = EmailMessage()
    m["Subject"], m["From"], m["To"], m["Date"], m["Message-ID"] = f"Subject {i}", "a@example.com", "b@example.com", f"Tue, 05 Mar 2024 09:{i % 60:02}:15 +0000", f"<{i}@example.com>"
    m.set_content(f"word{i} shared\n")
    return m.as_bytes()


def test_the_command_indexes_a_folder_of_both_kinds(spark, tmp_path, capsys):
    root, db = tmp_path / "mail", f"file://{tmp_path}/idx"
    root.mkdir()
    for i in range(20):
        (root / f"m{i:02}.eml").write_bytes(mail(i))
    (root / "Archive.mbox").write_bytes(b"".join(b"From - Tue Mar 05 09:30:15 2024\n" + mail(i) + b"\n" for i in range(100, 103)))
    run = lambda *args: command.main(["index", db, *args])
    assert run(f"file://{root}") == 0
    idx = index.Index(spark, db)
    messages = idx.messages().collect()
    assert len(messages) == 23 == len({r["id"] for r in messages}) == len({r["nid"] for r in messages})
    assert {r["body"] for r in messages} == {f"word{i} shared" for i in [*range(20), 100, 101, 102]}
    for i in (0, 19, 100, 101, 102):
        assert [r["subject"] for r in idx.search(f"word{i}").collect()] == [f"Subject {i}"]
    assert run(f"file://{root}") == 0 and "unchanged" in capsys.readouterr().out
    for form, out in (("eml", "hits"), ("html", "pages")):
        assert command.main(["find", db, "shared", "--export", f"file://{tmp_path}/{out}", "--format", form]) == 0
    exported = {f.read_bytes() for f in (tmp_path / "hits").rglob("*.eml")}
    assert len(exported) == 23 and exported >= {mail(0), mail(19)} and "23 exported, 0 failed" in capsys.readouterr().out
    assert len(list((tmp_path / "pages").rglob("*.html"))) == 23
    (root / "m03.eml").unlink()
    assert run(f"file://{root}") == 0 and found(idx, "word3") == 0 and found(idx, "shared") == 22
    other = tmp_path / "other"
    other.mkdir()
    (other / "x.eml").write_bytes(mail(7))
    assert run(f"file://{other}", "--optimize") == 0 and found(idx, "word7") == 2
    assert run(f"file://{root}", f"file://{tmp_path}/nowhere", "--prune") == 0 and found(idx, "word7") == 2  # a source that fails prunes nothing
    assert run(f"file://{root}", "--prune") == 0 and found(idx, "word7") == 1
    assert run("--remove", "mail") == 0 and idx.messages().count() == 0
    assert run(f"file://{tmp_path}/nowhere") == 1


def test_sources_of_one_name_at_two_places_are_two(spark, tmp_path):
    db = f"file://{tmp_path}/idx"
    for place, i in (("one", 1), ("two", 2)):
        (tmp_path / place / "mail").mkdir(parents=True)
        (tmp_path / place / "mail" / "x.eml").write_bytes(mail(i))
    uris = [f"file://{tmp_path}/{place}/mail" for place in ("one", "two")]
    assert command.main(["index", db, *uris]) == 0
    idx = index.Index(spark, db)
    assert found(idx, "word1") == 1 and found(idx, "word2") == 1
    assert {r["source_name"] for r in idx.sources().collect()} == {"mail", f"{tmp_path}/two/mail"}
    (tmp_path / "two" / "mail" / "y.eml").write_bytes(mail(3))
    assert command.main(["index", db, uris[1], uris[0] + "/", "--prune"]) == 0
    assert found(idx, "shared") == 3
    assert command.main(["index", db, uris[0], "--prune"]) == 0 and found(idx, "shared") == 1


def test_a_text_is_normalised_once(spark, tmp_path):
    """Postings, pairs, removals and compactions read the normalised texts that a message keeps; readers don't see them."""
    idx = index.Index(spark, f"file://{tmp_path}/i")
    rows = rows_of(spark, "a", 40).withColumn("body", F.format_string("Wörd  w%d, É", F.col("nid") % 7))
    idx.update(rows, prints(rows))
    stored = idx.store.read("messages", idx.store.current())
    for df in (index.packed(stored), index.counts_of(stored, 1), stored.select(index.length(stored))):
        assert "regexp_replace" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert {r["_n3"] for r in stored.select("_n3").collect()} == {f"word w{i} e" for i in range(7)}
    assert stored.where(index.length(stored) != F.col("length")).count() == 0
    assert not set(index.NORMS) & {*idx.messages().columns, *idx.search("word").columns}
    idx.optimize()
    again = idx.store.read("messages", idx.store.current())
    assert again.select("id", *[c for c in index.NORMS if c in again.columns]).exceptAll(stored.select("id", *[c for c in index.NORMS if c in stored.columns])).count() == 0


def test_counts_from_texts_are_those_of_postings(spark, tmp_path):
    rows = spark.createDataFrame([(i, i, "a b" if i % 2 else "", f"a{i % 3} a", "b b c" * (i % 4), None if i % 5 else "c") for i in range(1000)], "num long, batch long, subject string, sender string, body string, attachments string")
    stored = rows.withColumns(index.norms(rows))
    stored = stored.withColumn("length", index.length(stored).cast("int"))
    want = sorted(map(tuple, index.dictionary(index.packed(stored), 3, -1).collect()))
    assert sorted(map(tuple, index.counts_of(stored, 3, -1).collect())) == want and len(want) > 5
    assert index.counts_of(stored.limit(0), 3).count() == 0


def test_keys_in_order():
    import numpy as np

    keys = np.random.default_rng(1).integers(0, 50, 1000)
    for most in (50, 1 << 60):  # the second leaves no room for places
        assert (index._ordered(keys, most) == np.argsort(keys, kind="stable")).all()
    assert len(index._ordered(keys[:0], 1)) == 0


def test_many_removals_sort_no_texts(spark, tmp_path, monkeypatch):
    """Beyond what is broadcast, the narrow side of a join is hashed, and the messages aren't sorted."""
    monkeypatch.setattr(index, "SMALL", 0)
    monkeypatch.setattr(index, "NUMBERS", 0)
    idx, rows = index.Index(spark, f"file://{tmp_path}/i"), rows_of(spark, "a", 40)
    idx.update(rows, prints(rows))
    assert idx.update(rows.where("nid % 2 = 0"), prints(rows)) == {"added": 0, "kept": 20, "removed": 20}
    plan = idx._alive("messages", idx.store.current())._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    idx.optimize()
    assert found(idx, "common") == 20 and {r["token"]: r["df"] for r in idx.terms("common").collect()} == {"common": 20}
