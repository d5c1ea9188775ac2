from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from postlake.operators import search
from postlake.sources import embedded, extract, files, mime


def mail(name: str, *inside, text: str = "") -> EmailMessage:
    m = EmailMessage()
    m["Subject"], m["From"], m["To"] = name, f"{name}@example.com", "to@example.com"
    m.set_content(f"body of {name} {text}\n")
    for x in inside:
        if isinstance(x, EmailMessage):
            m.add_attachment(x)
        else:
            m.add_attachment(x[1], maintype="application", subtype="octet-stream", filename=x[0])
    return m


def deep(n: int) -> EmailMessage:
    m = mail(f"level{n}", ("leaf.txt", b"the leaf"))
    for i in range(n - 1, -1, -1):
        m = mail(f"level{i}", m)
    return m


@pytest.fixture(scope="module")
def messages(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("mail")
    tops = [mail("plain"), mail("a", mail("b", mail("c", ("x.txt", b"zebra")), ("y.txt", b"yak")), mail("d")), deep(7), mail("file", ("m.eml", mail("inside file", text="giraffe").as_bytes())), mail("broken", ("bad.eml", b"\xff\x00 no mail"))]
    for i, m in enumerate(tops):
        (root / f"{i}.eml").write_bytes(m.as_bytes())
    return mime.messages(files.read_files(spark, f"file://{root}")).withColumn("nid", F.shiftright("nid", files.PLACE)).cache()


def test_every_level_is_rows(messages):
    rows = {(r["nid"], *r["path"]): (r["subject"], r["depth"], r["folder"]) for r in embedded.unnested(messages).collect()}
    assert {k: v[0] for k, v in rows.items() if k[0] == 1} == {(1, 0): "b", (1, 0, 0): "c", (1, 1): "d"}
    assert {k: v[0] for k, v in rows.items() if k[0] == 2} == {(2, *[0] * i): f"level{i}" for i in range(1, 8)}
    assert rows[3, 0][0] == "inside file" and (4, 0) in rows and not any(k[0] == 0 for k in rows)
    assert all(v[1] == len(k) - 1 and v[2] == "" for k, v in rows.items())


def test_depth_and_total_are_parameters(messages):
    assert max(r["depth"] for r in embedded.unnested(messages, depth=3).collect()) == 3
    assert embedded.unnested(messages.where("nid = 0")).count() == 0 and embedded.unnested(messages.limit(0)).count() == 0
    sizes = {(r["nid"], *r["path"]): r["n"] for r in embedded.unnested(messages).select("nid", "path", F.octet_length("raw").alias("n")).collect()}
    for total in (0, 500, 900, 1500, 1 << 20):
        want, spent = set(), {}
        for k in sorted(sizes, key=lambda k: (len(k), k)):
            parent = k[:-1]
            if len(k) > 2 and parent not in want or spent.get(k[0], (0, 0))[1] == len(k):
                continue
            if spent.get(k[0], (0, 0))[0] + sizes[k] <= total:
                want.add(k)
                spent[k[0]] = (spent.get(k[0], (0, 0))[0] + sizes[k], 0)
            else:
                spent[k[0]] = (spent.get(k[0], (0, 0))[0], len(k))  # the rest of this level doesn't come in either
        got = {(r["nid"], *r["path"]) for r in embedded.unnested(messages, total=total).collect()}
        assert got == want, total


def test_text_counts_and_names_take_in_what_is_inside(messages):
    rows = {r["nid"]: r for r in extract.with_attachment_text(messages).collect()}
    assert rows[0]["attachments"] == "" and rows[0]["att_count"] == 0
    text = rows[1]["attachments"]
    assert [line for line in text.split("\n") if line.startswith("•")] == ["• b", "• c", "• x.txt", "• y.txt", "• d"]
    assert text.index("zebra") < text.index("yak") < text.index("body of d") and rows[1]["att_count"] == 5 and set(rows[1]["att_names"].split()) >= {"x.txt", "y.txt"}
    assert "the leaf" in rows[2]["attachments"] and rows[2]["att_count"] == 8
    assert "the leaf" not in {r["nid"]: r for r in extract.with_attachment_text(messages, depth=3).collect()}[2]["attachments"]
    found = extract.with_attachment_text(messages)
    assert [r["nid"] for r in search.find(found, "att:giraffe").collect()] == [3]


def test_totals(messages):
    rows = {r["nid"]: (r["attachments"], r["embedded"], r["size"]) for r in embedded.totals(messages).collect()}
    assert rows[0] == (0, 0, 0) and rows[1] == (5, 3, 8) and rows[2] == (8, 7, 8) and rows[3][:2] == (1, 1)


def test_reading_and_writing_are_the_standard_librarys():
    import email

    odd = [
        b"", b"\r", b"-", b"Subject: =?utf-8?q?caf=C3=A9?= x\r\nX: a  b\r\n\ty \r\nY: " + b"word " * 40 + b"\r\n\r\nFrom me\r\nold\rmac\n\x0c", b"Subject: \xe9\xff\nDate:\nReceived: x; Mon, 1 Jan 2024 10:00:00 +0100\n\n-\n--\n",
        b'Content-Type: multipart/digest; boundary="a"\r\n\r\n--a\r\n\r\nSubject: in\r\n\r\nx\r\n--a--\r\nafter', b'Content-Type: multipart/mixed; boundary="a"\n\n--a\nContent-Type: message/delivery-status\n\nA: b\n\nC: d\n\n--a\nContent-Type: multipart/mixed\n\n--b\n--a--',
        deep(3).as_bytes(), mail("a", mail("b", ("é.txt", b"yak"))).as_bytes(),
    ]
    for data in odd:
        want, got = email.message_from_bytes(data), mime.read(data)
        assert [(type(d), d.args, p.get_content_type(), p.items(), p.get_payload() if not p.is_multipart() else None) for p in got.walk() for d in (*p.defects, Exception())] == [(type(d), d.args, p.get_content_type(), p.items(), p.get_payload() if not p.is_multipart() else None) for p in want.walk() for d in (*p.defects, Exception())], data
        assert mime.written(got) == want.as_bytes() == mime.written(want), data


def test_a_body_line_costs_no_test_of_boundaries():
    """Lines that can end no part pass by the tests that every enclosing message adds."""
    asked = []

    def ends(line):
        asked.append(line)
        return line.startswith("--")

    lines = mime.Lines()
    lines.push("plain\n" * 1000 + "-dash\n\n--end\n")
    lines.push_eof_matcher(ends)
    assert len(list(lines)) == 1002 and asked == ["-dash\n", "\n", "--end\n"]


def test_attached_messages_stay_bytes_until_their_turn(monkeypatch):
    """A message takes its own parts apart, not those of what is attached to it, and hands that on as it stands."""
    inner = b"Subject:  in \r\nContent-Type: multipart/mixed; boundary=b\r\n\r\n--b\r\n\r\none\r\n--b\r\n\r\ntwo\r\n--b--"
    made, kind = [], mime.Outer
    monkeypatch.setattr(mime, "Outer", lambda *a, **b: made.append(1) or kind(*a, **b))
    found = mime.parse(b"Content-Type: multipart/mixed; boundary=a\r\n\r\n--a\r\nContent-Type: message/rfc822\r\n\r\n" + inner + b"\r\n--a--\r\n")
    (a,) = found["attachments"]
    assert a["data"] == inner and a["size"] == len(inner) and a["is_embedded"] and a["filename"] == "in.eml" and len(made) <= 3  # the parser makes one to try
    assert mime.parse(inner)["plain"] == "one\n\ntwo" and mime.parse(inner)["subject"] == "in"


def test_messages_that_share_an_id_or_have_none_keep_what_is_theirs(messages):
    same = messages.where("nid in (1, 3)").withColumn("nid", F.when(F.col("subject") == "a", 7).otherwise(7))
    none = messages.where("nid = 1").withColumns({"nid": F.lit(None).cast(messages.schema["nid"].dataType), "source_name": F.lit(None).cast("string")})
    rows = extract.with_attachment_text(same.unionByName(none)).collect()
    assert sorted((r["subject"], r["nid"], r["att_count"], "giraffe" in r["attachments"], "zebra" in r["attachments"]) for r in rows if r["nid"]) == [("a", 7, 5, False, True), ("file", 7, 1, True, False)]
    assert [(r["att_count"], "zebra" in r["attachments"]) for r in rows if not r["nid"]] == [(5, True)]


def test_queries_of_odd_documents(spark, tmp_path):
    """Empty and missing values, and ids that are repeated or missing, as the SQL has them."""
    import duckdb

    from postlake.plans import queries

    rows = [(1, "text", "en", "src1"), (2, "", "en", "src1"), (3, " \n\t ", "en", "src2"), (4, None, "en", "src2"), (5, "a", None, "src1"), (6, "b", "fr", None), (7, "c", "", "src1"), (8, "d", "fr", ""), (9, "e", "en", "src1"), (9, "f", "en", "src1"), (9, "f", "en", "src1"), (None, "g", "en", "src3"), (None, "h", "en", "src3"), (10, "é", "dé", "srç"), (11, "i", "en", "=?utf-8?q?x?=")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("embedded_text", "embedded_messages"):
        df = queries.queries()[name](spark, str(tmp_path))
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(db.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.oracle_sql()[name]})").fetchall(), key=repr), name
