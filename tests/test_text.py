import datetime as dt

import pytest
from pyspark.sql import functions as F

from postlake.functions import dates
from postlake.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


def test_html(spark):
    assert one(spark, "<p>One&nbsp;two</p><br><div>three</div>", T.html_to_text) == "One two\n\nthree"
    assert one(spark, "<p>Para <b>one</b></p><script>x</script>", T.html_to_text) == "Para one"
    assert one(spark, None, T.html_to_text) == ""


@pytest.mark.parametrize(("name", "want"), [('a<b>:"c/d\\e|f?g*h  .', "a_b___c_d_e_f_g_h"), ("CON", "_CON"), ("", "untitled"), (None, "untitled"), ("aux .tar.gz", "_aux .tar.gz"), ("x" * 200 + ".pdf", "x" * 120 + ".pdf")])
def test_sanitize(spark, name, want):
    assert one(spark, name, T.sanitize) == want


@pytest.mark.parametrize(("n", "want"), [(0, "0 B"), (None, "0 B"), (1023, "1023 B"), (1280, "1.2 KB"), (1536, "1.5 KB"), (5 << 20, "5.0 MB"), (3 << 40, "3072.0 GB")])
def test_size(spark, n, want):
    assert one(spark, n, T.human_size, "long") == want


def test_subject_and_junk(spark):
    assert one(spark, "\x01\x04RE: hi\r\nthere ", T.clean_subject) == "RE: hi  there"
    assert one(spark, "a\x02b", T.clean_text) == ""
    assert one(spark, "ab", T.clean_text) == "ab"


def test_vcard_escape(spark):
    assert one(spark, "a,b;c\\d\ne", T.vcard_escape) == "a\\,b\\;c\\\\d\\ne"


@pytest.mark.parametrize("at", [dt.datetime(1990, 5, 9, 23), dt.datetime(1990, 5, 10, 5), dt.datetime(1990, 5, 10), dt.datetime(1990, 5, 10, 11, 59)])
def test_birthday(spark, at):
    assert one(spark, at, dates.birthday, "timestamp") == dt.date(1990, 5, 10)


def test_stored_dates(spark):
    assert one(spark, 132539328000000000, dates.filetime, "long") == dt.datetime(2021, 1, 1)
    assert one(spark, 2.5, dates.ole_date, "double") == dt.datetime(1900, 1, 1, 12)


def test_fold(spark):
    assert one(spark, "Prüfung NAÏVE Straße", T.fold) == "prufung naive straße" == T.fold_text("Prüfung NAÏVE Straße")


def test_cards(spark):
    from postlake.sinks.contacts import vcard

    df = spark.createDataFrame([("Ada, L", ["ada@example.org", "c@example.net"], "n" * 100)], "n string, e array<string>, t string")
    card = df.select(vcard({"display_name": F.col("n"), "emails": F.col("e"), "notes": F.col("t")}, None)).first()[0]
    assert "FN:Ada\\, L\r\n" in card and "EMAIL;TYPE=INTERNET,PREF:ada@example.org\r\nEMAIL;TYPE=INTERNET:c@example.net\r\n" in card
    assert all(len(line.encode()) <= 75 for line in card.split("\r\n")) and "NOTE:" + "n" * 70 + "\r\n " + "n" * 30 in card


def test_types_and_numbers(spark):
    assert [one(spark, n, T.mime_type) for n in ("a.PDF", "b.docx", "c", None)] == ["application/pdf", T.MIME_TYPES["docx"], "application/octet-stream", "application/octet-stream"]
    assert one(spark, 1234567, T.thousands, "long") == "1,234,567"


def test_contact_text(spark):
    from postlake.sinks.contacts import contact_text

    df = spark.createDataFrame([("Ada", "", None)], "n string, e string, p string")
    assert df.select(contact_text({"Name": F.col("n"), "E-mail": F.col("e"), "Phone": F.col("p")})).first()[0] == "Name: Ada"


def test_pages_with_references_that_lack_their_semicolon(spark, tmp_path):
    import duckdb

    from postlake.plans import queries as mail

    pages = ["<title>and&amp</title><p>a &amp; b &lt;c&gt; &amp;lt; &copy=1", "x&nbsp;y &nbsp &#39;q&#39 &notit; &mdash;", "&", "&;", None]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(db.sql(mail.oracle_sql()["html_to_text"]).fetchall())
    assert sorted(tuple(r) for r in mail.queries()["html_to_text"](spark, str(tmp_path)).collect()) == want
    assert one(spark, "<p>and&amp</p>", T.html_to_text) == "and&"  # bodies of messages, as the reference has it


def test_a_safe_name_is_as_the_whole_rule_has_it(spark):
    names = ["a b", "a  b", " a", "a.", "con", "Com1", "CONIN$", "lpt9 x", "1994-01-02 030405 Customer#000000001", "x" * 121, "y" * 140, "é", "a\tb", "a/b", "a\n", "", None, "ends ", "(2), x=y"]
    rows = spark.createDataFrame(list(enumerate(names)), "i long, s string").select(T.sanitize(F.col("s")).alias("a"), T._sanitized(F.col("s"), 120, 200).alias("b"), F.col("s").rlike(T.SAFE).alias("c"))
    got = rows.collect()
    assert [r["a"] for r in got] == [r["b"] for r in got]
    assert {n for n, r in zip(names, got, strict=True) if r["c"]} >= {"a b", "1994-01-02 030405 Customer#000000001"}
