import datetime as dt

import pytest

from postlake.functions.dates import listing_bound
from postlake.operators.filters import RowFilter, attachment_kind, parse_extensions

ROWS = [
    (1, "Invoice 42", "Alice <alice@example.com>", "bob", dt.datetime(2019, 3, 15, 12), 100, True, "IPM.Note", "please find the pdf attached"),
    (2, "Holiday photos", "Carol", "bob", dt.datetime(2020, 7, 1), 500, True, "IPM.Note", "beach"),
    (3, "No date at all", "Dave", "bob", None, 10, False, "IPM.Note", "invoice inside"),
    (4, "Ada Lovelace", "", "", dt.datetime(2018, 1, 1), 5, False, "IPM.Contact", None),
    (5, "Meeting", "Erin", "bob", dt.datetime(2019, 3, 15, 12), 5, False, "IPM.Appointment", None),
]
ATTS = [(1, "invoice.pdf", False), (1, "logo.png", True), (2, "IMG_1.jpg", False)]
INVOICE, HOLIDAY, UNDATED, ADA, MEETING = (r[1] for r in ROWS)


@pytest.fixture(scope="module")
def listing(spark):
    return spark.createDataFrame(ROWS, "nid long, subject string, sender string, to string, date timestamp, size long, has_attachments boolean, message_class string, body string")


@pytest.fixture(scope="module")
def attachments(spark):
    return spark.createDataFrame(ATTS, "nid long, filename string, is_inline boolean")


@pytest.mark.parametrize(
    ("f", "expected"),
    [
        (RowFilter(), [r[1] for r in ROWS]),
        (RowFilter(text="invoice"), [INVOICE]),
        (RowFilter(text="invoice", search_body=True), [INVOICE, UNDATED]),
        (RowFilter(text="invoice pdf", search_body=True), [INVOICE]),
        (RowFilter(since="2019-03-15"), [INVOICE, HOLIDAY, MEETING]),
        (RowFilter(until="2019"), [INVOICE, ADA, MEETING]),
        (RowFilter(since="2019-03", until="2019-03"), [INVOICE, MEETING]),
        (RowFilter(text="date"), [UNDATED]),
        (RowFilter(has_attachments=True), [INVOICE, HOLIDAY]),
        (RowFilter(attachment_type="documents"), [INVOICE]),
        (RowFilter(attachment_type="images"), [HOLIDAY]),
        (RowFilter(contacts_only=True), [ADA]),
        (RowFilter(only_mail=True), [INVOICE, HOLIDAY, UNDATED]),
    ],
)
def test_cases(listing, attachments, f, expected):
    found = f.apply(listing, attachments).orderBy("nid").collect()
    assert [r["subject"] for r in found] == expected


def test_unknown_bodies_and_names_do_not_match(spark, listing, attachments):
    from pyspark.sql import functions as F

    unknown = listing.withColumn("body", F.lit(None).cast("string"))
    assert RowFilter(text="beach", search_body=True).apply(unknown).count() == 0
    assert RowFilter(attachment_type="images").apply(listing, attachments.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "start", "end"),
    [
        ("2019", dt.datetime(2019, 1, 1), dt.datetime(2019, 12, 31, 23, 59, 59, 999999)),
        ("2019-03", dt.datetime(2019, 3, 1), dt.datetime(2019, 3, 31, 23, 59, 59, 999999)),
        ("2019/03/15", dt.datetime(2019, 3, 15), dt.datetime(2019, 3, 15, 23, 59, 59, 999999)),
        (" 2019-3-5 ", dt.datetime(2019, 3, 5), dt.datetime(2019, 3, 5, 23, 59, 59, 999999)),
        ("2020-02", dt.datetime(2020, 2, 1), dt.datetime(2020, 2, 29, 23, 59, 59, 999999)),
        ("2019-12", dt.datetime(2019, 12, 1), dt.datetime(2019, 12, 31, 23, 59, 59, 999999)),
        ("1965-06", dt.datetime(1965, 6, 1), dt.datetime(1965, 6, 30, 23, 59, 59, 999999)),
    ],
)
def test_bounds(text, start, end):
    assert listing_bound(text) == start
    assert listing_bound(text, end=True) == end


@pytest.mark.parametrize("text", ["", "  ", None, "last week", "2019-13", "2019-02-30", "0000", "2019-00"])
def test_no_bound(text):
    assert listing_bound(text) is None


def test_kinds(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a.PDF",), ("b.docx",), ("c.jpeg",), ("d.tar.gz",), ("e.exe",), ("f",), (None,)], "n string")
    assert [r[0] for r in df.select(attachment_kind(F.col("n"))).collect()] == ["documents", "documents", "images", "archives", "other", "other", "other"]
    assert parse_extensions("pdf, .DOCX xlsx;zip") == {"pdf", "docx", "xlsx", "zip"}


def test_whole_bodies_are_searched_and_hashed(spark):
    from pyspark.sql import functions as F

    from postlake.functions.text import body_text

    long = "x" * 500_000 + " license"
    df = spark.createDataFrame([(1, "", long)], "nid long, subject string, body string")
    f = RowFilter(text="license", search_body=True)
    assert df.where(f.compile(df.columns)).count() == 1 and df.where(f.compile(df.columns, body_cap=65_536)).count() == 0
    assert df.select(body_text(F.col("body"))).first()[0] == long
    assert len(df.select(body_text(F.col("body"), 400_000)).first()[0]) == 400_000
