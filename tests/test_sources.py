import io
import zipfile
import zlib
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from postlake.operators import search
from postlake.sources import extract, files, mbox, mime


def office(path: str, xml: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(path, xml)
    return out.getvalue()


def message(i: int, docx: bool = False) -> bytes:
    m = EmailMessage()
    m["Subject"], m["From"], m["To"] = f"Bulk message {i:03}" if i else "Prüfung – naïve café ☕", f"Sender {i % 7} <s{i % 7}@example.com>", "Bob <bob@example.com>, carol@example.net"
    m["Date"], m["Message-ID"] = f"Tue, 05 Mar 2024 09:{i % 60:02}:15 +0000", f"<{i}@example.com>"
    m.set_content(f"Body of {i}\nFrom here on\n")
    if docx:
        m.add_attachment(office("word/document.xml", "<w:p>Penalty clause zebra</w:p>"), maintype="application", subtype="octet-stream", filename="terms.docx")
    return m.as_bytes()


def test_loose_files_and_maildir(spark, tmp_path):
    root = tmp_path / "mail"
    for d in ("Inbox", "Inbox/Project", "box/cur", "box/new", "box/.Projects/cur"):
        (root / d).mkdir(parents=True)
    (root / "Inbox/a.eml").write_bytes(message(0, docx=True))
    (root / "Inbox/Project/b.eml").write_bytes(message(1))
    raw = message(2)
    (root / "Inbox/c.emlx").write_bytes(str(len(raw)).encode() + b"\n" + raw + b"<?xml version='1.0'?><plist/>")
    (root / "box/cur/1:2,S").write_bytes(message(3))
    (root / "box/cur/2:2,ST").write_bytes(message(4))
    (root / "box/new/3").write_bytes(message(5))
    (root / "box/new/4").write_bytes(b"")
    (root / "box/.Projects/cur/5!2,").write_bytes(message(6))
    (root / "note.txt").write_text("no mail")
    rows = {r["subject"]: r for r in mime.messages(files.read_files(spark, f"file://{root}")).drop("raw").collect()}
    assert set(rows) == {"Prüfung – naïve café ☕", *(f"Bulk message {i:03}" for i in (1, 2, 3, 5, 6))}
    first = rows["Prüfung – naïve café ☕"]
    assert first["folder"] == "Inbox" and first["sender"] == "Sender 0 <s0@example.com>" and first["to"] == "Bob; carol@example.net"
    assert first["recipients"] == "Bob <bob@example.com>; carol@example.net" and first["has_attachments"] and first["att_names"] == "terms.docx"
    assert first["body"] == "Body of 0\nFrom here on" and first["date"].isoformat() == "2024-03-05T09:00:15"
    assert rows["Bulk message 001"]["folder"] == "Inbox/Project"
    assert rows["Bulk message 003"]["is_read"] and not rows["Bulk message 005"]["is_read"] and not rows["Bulk message 006"]["is_read"]
    kinds = {(r["kind"], r["files"]) for r in files.find_sources(spark, f"file://{root}").collect()}
    assert ("files", 3) in kinds


def test_attachment_text_is_searchable(spark, tmp_path):
    (tmp_path / "x.eml").write_bytes(message(0, docx=True))
    m = extract.with_attachment_text(mime.messages(files.read_files(spark, f"file://{tmp_path}")))
    hit = search.with_snippets(search.find(m, "att:zebra"), "att:zebra").first()
    assert hit["matched_in"] == "attachment" and "[zebra]" in hit["snippet"]


@pytest.mark.parametrize(("name", "data", "want"), [
    ("a.xlsx", office("xl/sharedStrings.xml", "<si><t>Alpha</t></si><si><t>42</t></si>"), "Alpha\n42"), ("b.zip", office("notes.txt", "secret phrase"), "notes.txt\nsecret phrase"),
    ("c.html", b"<p>Para <b>one</b></p><script>x</script>", "Para one"), ("d.pdf", b"%PDF junk", ""), ("e.docx", b"not a zip", ""), ("f.txt", b"plain", "plain"), ("g.rtf", rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}Hello \b from\b0  RTF\par caf\'e9 \u8364?}", "Hello from RTF\ncaf\u00e9 \u20ac"),
    ("h.pdf", b"%PDF-1.4\n1 0 obj<<>>stream\n" + zlib.compress(b"BT (Quarterly) Tj ( report \\(giraffe\\)) Tj ET") + b"\nendstream", "Quarterly report (giraffe)"),
    ("i.eml", b"Subject: inner subject\nFrom: a@b.c\n\ninner body text\n", "inner subject\na@b.c\ninner body text"), ("j.odt", office("content.xml", "<text:p>Alpha beta</text:p><text:p>Gamma</text:p>"), "Alpha beta\nGamma"),
    ("m.txt", "Prüfung €".encode("cp1252"), "Prüfung €"), ("n.csv", b"\xff\xfe" + "naïve;x".encode("utf-16-le"), "naïve;x"), ("o.md", b"\xef\xbb\xbf\xc3\xa9t\xc3\xa9", "été"), ("p.txt", b"w " * 300_000 + b"end", ("w " * 300_000 + "end")),
    ("q.xls", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1\x00\x01" + "wide words".encode("utf-16-le") + b"\x01\x02narrow ones", "narrow ones\nwide words"),
    ("k.doc", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1\x00\x01legacy words\x00\x02abc\x00", "legacy words"), ("l.png", b"\x89PNG", ""),
])
def test_extract(spark, name, data, want):
    df = spark.createDataFrame([(name, bytearray(data))], "n string, d binary")
    assert df.select(extract.attachment_text(F.col("d"), F.col("n"))).first()[0].strip() == want


def separated(parts: list[bytes]) -> bytes:
    return b"".join(b"From - Tue Mar 05 09:30:15 2024\n" + p + b"\n" for p in parts)


@pytest.mark.parametrize("size", [1 << 28, 700, 97])
def test_mbox_ranges(spark, tmp_path, size):
    box = tmp_path / "Archive.mbox"
    parts = [message(i).replace(b"\nFrom ", b"\n>From ") for i in range(1, 41)]
    box.write_bytes(separated(parts))
    reader = mbox.MboxReader({"path": f"file://{box}", "splitbytes": str(size)})  # as Spark hands options on
    assert len(reader.partitions()) == -(-box.stat().st_size // size)
    rows = mbox.read_mbox(spark, f"file://{box}", size).orderBy("offset").collect()
    assert [bytes(r["raw"]) for r in rows] == parts
    assert {r["folder"] for r in rows} == {"Archive"} and [r["nid"] for r in rows] == [r["offset"] for r in rows]
    assert mbox.read_mbox(spark, f"file://{box}", size).rdd.getNumPartitions() == -(-box.stat().st_size // size)


def with_length(body: bytes, stated: int | None = None) -> bytes:
    return b"Subject: x\nContent-Length: %d\n\n" % (len(body) if stated is None else stated) + body


def test_mbox_content_length_is_the_same_at_every_split(spark, tmp_path):
    """Stated lengths over separators, wrong ones, ones that land inside another message, a whole mbox in a body."""
    quoted = b"quoted:\n\nFrom nobody\nSubject: inner\n\nend\n"
    inner = separated([with_length(b"deep\n\nFrom x\n\ny\n"), b"Subject: z\n\nz\n"])
    long = b"l\n" * 300 + b"\nFrom far\n\n" + b"m\n" * 300
    parts = [with_length(quoted), with_length(b"a\n", 5), with_length(inner), b"Subject: y\n\nz\n", with_length(long), with_length(b""), with_length(b"no end\n", 9999), with_length(b"\nFrom\n"), b"Subject: last\n\nbody\n"]
    box = tmp_path / "Sent.mbox"
    box.write_bytes(separated(parts))
    want = [bytes(r["raw"]) for r in mbox.read_mbox(spark, f"file://{box}").orderBy("offset").collect()]
    assert want == parts
    for size in (50, 131, 400, 1000):
        rows = mbox.read_mbox(spark, f"file://{box}", size).orderBy("offset").collect()
        assert [bytes(r["raw"]) for r in rows] == parts, size
        assert [r["size"] for r in rows] == [len(p) for p in parts]


def test_mbox_headers_only(spark, tmp_path):
    parts = [message(i, docx=i % 2 == 0).replace(b"\nFrom ", b"\n>From ") + b"x" * 100_000 + b"\n" for i in range(1, 5)]
    (tmp_path / "Big.mbox").write_bytes(separated(parts))
    raw = mbox.read_mbox(spark, f"file://{tmp_path}/Big.mbox", head_only=True)
    assert raw.selectExpr("max(octet_length(raw))").first()[0] < 1000
    rows = mime.heads(raw).orderBy("nid").collect()
    whole = mime.messages(mbox.read_mbox(spark, f"file://{tmp_path}/Big.mbox")).orderBy("nid").collect()
    for c in ("subject", "sender", "to", "recipients", "date", "size", "is_read", "message_id"):
        assert [r[c] for r in rows] == [r[c] for r in whole]
    assert [r["has_attachments"] for r in rows] == [i % 2 == 0 for i in range(1, 5)]


def test_listings_read_heads_of_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.eml").write_bytes(message(1) + b"x" * 200_000)
    (tmp_path / "a/two.eml").write_bytes(message(0, docx=True))
    (tmp_path / "a/loop").symlink_to(tmp_path, target_is_directory=True)
    (tmp_path / "a/gone.eml").symlink_to(tmp_path / "nowhere")
    raw = files.read_files(spark, f"file://{tmp_path}/a", head_only=True)
    assert raw.selectExpr("max(octet_length(raw))").first()[0] <= 64 << 10
    rows = mime.heads(raw).orderBy("nid").collect()
    assert [(r["subject"], r["has_attachments"]) for r in rows] == [("Bulk message 001", False), ("Prüfung – naïve café ☕", True)]
    assert rows[0]["size"] == len(message(1)) + 200_000
    one = mime.messages(files.read_files(spark, f"file://{tmp_path}/a/two.eml")).collect()
    assert [r["subject"] for r in one] == ["Prüfung – naïve café ☕"] and one[0]["folder"] == ""


def test_unreadable_files_are_rows(spark):
    rows = spark.createDataFrame([("s", "f", 1, "eml", None, None, "denied")], "source_name string, folder string, nid long, kind string, raw binary, flag_read boolean, error string")
    assert mime.messages(rows).first()["subject"] == "(unreadable: denied)" == mime.heads(rows).first()["subject"]


def test_thunderbird_and_packages(spark, tmp_path):
    root = tmp_path / "profile"
    for d in ("Archive.sbd", "A.mbox/B.mbox", "C.mbox/Data/1/Messages"):
        (root / d).mkdir(parents=True)
    (root / "Inbox").write_bytes(separated([message(1), message(2)]))
    (root / "Archive").write_bytes(b"")
    (root / "Archive.sbd/2024").write_bytes(separated([message(3)]))
    (root / "Inbox.msf").write_bytes(b"From no mail")
    (root / "notes").write_bytes(b"some words")
    (root / "A.mbox/B.mbox/mbox").write_bytes(separated([message(4)]))
    (root / "C.mbox/Data/1/Messages/5.emlx").write_bytes(str(len(message(5))).encode() + b"\n" + message(5))
    rows = {(r["folder"], r["subject"]) for r in mime.messages(mbox.read_mbox(spark, f"file://{root}")).collect()}
    assert rows == {("Inbox", "Bulk message 001"), ("Inbox", "Bulk message 002"), ("Archive/2024", "Bulk message 003"), ("A/B", "Bulk message 004")}
    assert [r["folder"] for r in mime.messages(files.read_files(spark, f"file://{root}")).collect()] == ["C"]
    found = {(r["kind"], r["source"].removeprefix(f"{root}")) for r in files.find_sources(spark, f"file://{root}").collect()}
    assert {("mbox", "/Inbox"), ("mbox", "/Archive")} <= found and not any("notes" in s or "msf" in s for _, s in found)


@pytest.mark.parametrize(("name", "head", "kind"), [("x", b"From a", "mbox"), ("x.dat", b"!BDN..", "pst"), ("mail.txt", b"Subject: x\n", "eml"), ("a.EMLX", b"12\n", "emlx"), ("b.mbx", b"", "mbox"), ("c.bin", b"\x00\x01", None)])
def test_kind_of_one_file(name, head, kind):
    assert files.kind_of_file(name, head) == kind


def test_broken_messages_do_not_fail(spark):
    rows = spark.createDataFrame([("s", "f", 1, "eml", bytearray(b"\xff\x00" * 50), None), ("s", "f", 2, "eml", bytearray(b"Subject: =?x?Q?=\n\nhi"), None)], "source_name string, folder string, nid long, kind string, raw binary, flag_read boolean")
    assert mime.messages(rows).count() == 2


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    from postlake.operators.index import Index
    from postlake.streaming.ingest import index_stream, new_files

    inbox = tmp_path / "in"
    inbox.mkdir()
    idx = Index(spark, f"file://{tmp_path}/idx")

    def listed(batch):
        raw = batch.select(F.lit("in").alias("source_name"), F.lit("").alias("folder"), F.xxhash64("path").alias("nid"), F.lit("eml").alias("kind"), F.col("content").alias("raw"), F.lit(None).cast("boolean").alias("flag_read"))
        return extract.with_attachment_text(mime.messages(raw)).drop("raw", "html")

    for i in (1, 2):
        (inbox / f"{i}.eml").write_bytes(message(i))
        q = index_stream(new_files(spark, f"file://{inbox}"), listed, idx, f"file://{tmp_path}/check")
        q.awaitTermination()
    assert idx.messages().count() == 2 and idx.search("bulk 002").count() == 1


def test_messages_are_parsed_in_portions_of_bounded_bytes():
    import pyarrow as pa

    from postlake.sources import mime

    raw = pa.array([b"x" * n if n is not None else None for n in (1, mime.PORTION, None, 5, 3 * mime.PORTION, 7, mime.PORTION - 7, 0)], pa.binary())
    assert list(mime.portions(raw)) == [(0, 1), (1, 3), (3, 4), (4, 5), (5, 8)]
    assert list(mime.portions(raw.slice(5))) == [(0, 3)] and list(mime.portions(raw.slice(0, 0))) == []
