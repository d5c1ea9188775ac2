import datetime as dt
import email
import os

import pytest
from pyspark.sql import functions as F

from postlake.sinks import messages as sink
from postlake.sources import files, mbox, mime

ROWS = [
    (1, "in", "Inbox/A:B", "Prüfung <1>", "Zoë <z@example.com>", "Bob", dt.datetime(2024, 3, 5, 9, 30, 15), 10, "first\nFrom here\n", "IPM.Note"),
    (2, "in", "Inbox/A:B", "prüfung <1>", "Zoë <z@example.com>", "Bob", dt.datetime(2024, 3, 5, 9, 30, 15), 20, "second", "IPM.Note"),
    (3, "in", "Sent", None, "", "", None, None, None, "IPM.Note"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "nid long, source_name string, folder string, subject string, sender string, to string, date timestamp, size long, body string, message_class string").cache()


def test_paths_are_safe_and_unique(rows):
    paths = [r["path"] for r in sink.output_paths(rows, "eml").orderBy("nid").collect()]
    assert paths == ["Inbox/A_B/2024-03-05 093015 Prüfung _1_.eml", "Inbox/A_B/2024-03-05 093015 prüfung _1_ (2).eml", "Sent/undated (no subject).eml"]


def test_eml_files_read_back(spark, rows, tmp_path):
    done = sink.write_files(sink.as_eml(sink.output_paths(rows, "eml")), f"file://{tmp_path}/out").collect()
    assert all(r["error"] is None for r in done) and sum(f.endswith(".eml") for _, _, found in os.walk(tmp_path) for f in found) == 3
    back = {r["body"]: r for r in mime.messages(files.read_files(spark, f"file://{tmp_path}/out")).collect()}
    assert back["first\nFrom here"]["subject"] == "Prüfung <1>" and back["second"]["date"] == dt.datetime(2024, 3, 5, 9, 30, 15)
    assert back["second"]["folder"] == "Inbox/A_B" and "" in back


def test_raw_messages_pass_through(spark):
    raw = b"Subject: x\r\n\r\nas it was \xff\r\n"
    df = spark.createDataFrame([(1, "s", "f", "x", "a", "b", dt.datetime(2024, 1, 1), 1, "other", bytearray(raw))], "nid long, source_name string, folder string, subject string, sender string, to string, date timestamp, size long, body string, raw binary")
    assert bytes(sink.as_eml(df).first()["content"]) == raw


def test_mbox_reads_back(spark, rows, tmp_path):
    sink.write_mbox(rows, f"file://{tmp_path}/box")
    back = mime.messages(mbox.read_mbox(spark, f"file://{tmp_path}/box")).collect()
    assert sorted(r["body"] for r in back) == ["", "first\nFrom here", "second"]


def test_mbox_keeps_bytes_of_any_charset(spark, tmp_path):
    raw = b"Subject: caf\xe9\nContent-Type: text/plain; charset=latin-1\n\n\xe9t\xe9 \x80\xff\n>From x\nFrom y\n"
    df = spark.createDataFrame([(1, "s", "f", dt.datetime(2024, 1, 1), bytearray(raw), "b", "a", "x")], "nid long, source_name string, folder string, date timestamp, raw binary, body string, sender string, subject string")
    sink.write_mbox(df, f"file://{tmp_path}/box")
    data = next(tmp_path.glob("box/folder=f/*.txt")).read_bytes()
    assert data == b"From - Mon Jan 01 00:00:00 2024\n" + raw.replace(b">From x", b">>From x").replace(b"\nFrom y", b"\n>From y") + b"\n\n"


def test_text_and_html(rows):
    text = sink.as_text(rows).orderBy("nid").first()["content"]
    assert text.startswith("From: Zoë <z@example.com>\nTo: Bob\nDate: 2024-03-05 09:30:15\nSubject: Prüfung <1>\n\nfirst")
    page = sink.as_html(rows).orderBy("nid").first()["content"]
    assert "Prüfung &lt;1&gt;" in page and "<1>" not in page
    assert email.message_from_bytes(bytes(sink.as_eml(rows).orderBy("nid").first()["content"])).get_content_type() == "text/plain"


def test_index_and_reports(spark, rows, tmp_path):
    sink.write_index(sink.output_paths(rows, "eml"), f"file://{tmp_path}/index")
    back = spark.read.option("header", True).csv(f"file://{tmp_path}/index/index.csv")
    assert back.columns == ["file", "folder", "date", "from", "to", "subject", "size", "attachments", "message_id", "message_class", "exported_as"] and back.count() == 3
    report = rows.groupBy("folder").agg(F.sum("size").alias("size"))
    assert {r["line"] for r in sink.report_text(report).collect()} == {"Inbox/A:B  30 B", "Sent  0 B"}
    sink.write_reports({"folders": report}, f"file://{tmp_path}/reports")
    assert os.path.isdir(tmp_path / "reports/folders.csv")


def test_rebuilt_messages_keep_attachments_html_and_ids(spark, tmp_path):
    inner = b"Subject: inner \xff\r\n\r\nhello\r\n"
    atts = [("terms \u00e9+1.pdf", "application/pdf", "", False, False, False, 4, bytearray(b"%PDF\x00"[:4])), ("pic.png", "image/png", "p1", True, True, False, 3, bytearray(b"\x89PN")), ("inner.eml", "message/rfc822", "", False, False, True, len(inner), bytearray(inner)), ("", "", "", False, False, False, None, None)]
    schema = f"nid long, source_name string, folder string, subject string, sender string, to string, date timestamp, body string, html string, message_id string, attachments array<{mime.ATTACHMENT}>"
    rows = [(1, "s", "f", "With parts \u00fc", "a@b.c", "d@e.f", dt.datetime(2024, 1, 2), "plain \u00fc text", "<html><head><style>b{}</style></head><body class=x><b>rich</b> <img src='cid:p1'></body></html>", "<1@x>", atts), (2, "s", "f", "None", "a@b.c", "d@e.f", None, None, "", "", []), (3, "s", "f", "Null", None, None, None, "x", None, None, None)]
    df = spark.createDataFrame(rows, schema)
    made = {r["nid"]: bytes(r["content"]) for r in sink.as_eml(df).collect()}
    raw = spark.createDataFrame([("s", "f", i, "eml", bytearray(b), None) for i, b in made.items()], "source_name string, folder string, nid long, kind string, raw binary, flag_read boolean")
    back = {r["nid"]: r for r in mime.messages(raw).collect()}
    first = back[1]
    assert (first["subject"], first["body"], first["message_id"], first["date"]) == ("With parts \u00fc", "plain \u00fc text", "<1@x>", dt.datetime(2024, 1, 2))
    assert first["html"] == rows[0][8]
    found = [(a["filename"], a["mime"], a["cid"], bytes(a["data"])) for a in first["attachments"]]
    assert found[:2] == [("terms \u00e9+1.pdf", "application/pdf", "", b"%PDF"), ("pic.png", "image/png", "p1", b"\x89PN")]
    assert found[2][:2] == ("inner.eml", "message/rfc822") and b"hello" in found[2][3] and found[3] == ("", "application/octet-stream", "", b"")
    assert back[2]["attachments"] == [] and back[3]["body"] == "x"
    pages = {r["nid"]: r["content"] for r in sink.as_html(df).collect()}
    assert "<style>b{}</style><b>rich</b> <img src='data:image/png;base64,iVBO'>" in pages[1] and "<li>terms \u00e9+1.pdf (4 B)</li>" in pages[1] and "pic.png" not in pages[1].split("<hr>")[0]
    assert "<hr><pre></pre></body>" in pages[2] and "<hr><pre>x</pre>" in pages[3]


def test_the_report_page_holds_every_report_in_order(spark, rows, tmp_path):
    reports = {"folders <all>": rows.groupBy("folder").agg(F.count("*").alias("messages"), F.sum("size").alias("size")).orderBy(F.desc("messages")), "none": rows.limit(0).select("subject")}
    sink.write_report_page(reports, f"file://{tmp_path}/page")
    page = next(tmp_path.glob("page/part-*")).read_text()
    lines = page.splitlines()
    assert lines[0].startswith("<!DOCTYPE html>") and lines[-1] == "</body></html>" and "<h2>folders &lt;all&gt;</h2>" in lines[1]
    assert lines[2].startswith("<tr><td>Inbox/A:B</td><td>2</td><td>30 B</td>") and 'width:200px' in lines[2] and 'width:100px' in lines[3]
    assert lines[4:] == ["</table>", "<h2>none</h2><table><tr><th>subject</th></tr>", "</table>", "</body></html>"]


# Exports

FILES = [(f"d{i % 3}/f{i}.txt", bytes([i]) * i) for i in range(40)]


def files_of(spark, rows):
    return spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in rows], "path string, content binary").repartition(4)


def on_disk(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, found in os.walk(root) for f in found if "export-log" not in d}


def test_an_export_is_whole_and_logged(spark, tmp_path):
    from postlake.sinks import export

    odd = [("../out.txt", b"x"), ("/abs", b"x"), (None, b"x"), ("d0/none", None)]
    log = export.export(files_of(spark, FILES + odd), f"file://{tmp_path}/out")
    assert on_disk(tmp_path / "out") == dict(FILES)
    done = export.summary(log).first()
    assert (done["exported"], done["failed"]) == (40, 4) and export.log_lines(log).count() == 4
    assert not (tmp_path / "out.txt").exists() and not [f for f in os.listdir(tmp_path / "out") if f.startswith(".staged")]
    assert export.export(files_of(spark, []), f"file://{tmp_path}/empty").count() == 0


def test_nothing_shows_before_the_commit_and_an_abort_leaves_nothing(spark, tmp_path):
    from postlake.sinks import export

    root = f"file://{tmp_path}/out"
    (tmp_path / "out").mkdir()
    broken = files_of(spark, FILES).withColumn("path", F.when(F.col("path") == "d1/f31.txt", F.raise_error(F.lit("boom"))).otherwise(F.col("path")))
    with pytest.raises(Exception, match="boom"):
        export.stage(broken, root)
    assert os.listdir(tmp_path / "out") == [] and export.committed(root) == []
    job = export.stage(files_of(spark, FILES), root)
    assert on_disk(tmp_path / "out").keys() & dict(FILES).keys() == set() and export.committed(root) == [job]
    # A publication that broke off after some moves goes on where it was.
    stage = tmp_path / "out" / f".staged-{job}"
    (stage / "0123-lost-attempt").mkdir()
    (stage / "0123-lost-attempt" / "0").write_bytes(b"half")
    import json

    attempt = next(a for a in json.loads((stage / "committed.json").read_text())["attempts"] if (stage / a / "0").exists())
    entry = json.loads((stage / attempt / "list").read_text().splitlines()[0])
    (tmp_path / "out" / os.path.dirname(entry["path"])).mkdir()
    os.rename(stage / attempt / "0", tmp_path / "out" / entry["path"])
    assert export.publish(spark, root, job).where("error is null").count() == 40
    assert on_disk(tmp_path / "out") == dict(FILES) and export.committed(root) == []


def test_a_retried_task_counts_once(tmp_path):
    """Two attempts of a task stage the same files; only the one that the commit names is published."""
    import pyarrow as pa

    from postlake.sinks import export

    writer = export.ExportWriter({"path": f"file://{tmp_path}/out", "job": "j"})
    batch = pa.RecordBatch.from_pydict({"path": pa.array(["a", "b"]), "content": pa.array([b"1", b"22"], pa.binary())})
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch, batch.slice(0, 0)]))
    writer.commit([kept, None])
    import json

    said = json.loads((tmp_path / "out/.staged-j/committed.json").read_text())
    assert said == {"attempts": [kept.attempt], "files": 2, "failed": 0, "size": 3} and lost.attempt != kept.attempt
    writer.abort([])
    assert os.listdir(tmp_path / "out") == []


def test_paths_per_source(rows):
    assert {r["path"].split("/")[0] for r in sink.output_paths(rows, "eml", per_source=True).collect()} == {"in"}
