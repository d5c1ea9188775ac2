import os
import time

from pyspark.sql import functions as F

from postlake.streaming.growing import GrowingReader, appended


def entry(i: int, body: str = "") -> bytes:
    return f"From - Tue Mar 05 09:30:15 2024\nSubject: m{i}\n\n{body or f'body {i}'}\n\n".encode()


def grow(path, *parts: bytes):
    with open(path, "ab") as f:
        f.write(b"".join(parts))


def batches(reader, start):
    end = reader.latestOffset()
    rows = [r for p in reader.partitions(start, end) for b in reader.read(p) for r in b.to_pylist()]
    reader.commit(end)
    return rows, end


def test_offsets_are_bytes_where_messages_begin(tmp_path):
    box, state = tmp_path / "mail" / "Inbox.mbox", f"file://{tmp_path}/state"
    box.parent.mkdir()
    options = {"path": f"file://{box.parent}", "idle": "3600", "state": state}
    reader = GrowingReader(options)
    assert batches(reader, {})[0] == []
    grow(box, entry(1), entry(2))
    rows, at = batches(reader, {})
    assert [r["raw"].split(b"\n")[0] for r in rows] == [b"Subject: m1"] and at == {str(box): len(entry(1))}  # the last may go on
    grow(box, entry(3)[:30])
    rows, at = batches(reader, at)
    assert rows[0]["raw"].startswith(b"Subject: m2")
    grow(box, entry(3)[30:], entry(4))
    first, end = batches(reader, at)
    again = [r for p in reader.partitions(at, end) for b in reader.read(p) for r in b.to_pylist()]
    assert [r["raw"].split(b"\n")[0] for r in first] == [b"Subject: m3"] and first == again  # a replayed batch is the same
    # A quoted separator under a stated length is text, also where the batch begins behind it.
    quoted = "From nobody\nx\n\nFrom me\ny"
    grow(box, b"From - x\nSubject: m5\nContent-Length: %d\n\n%s\n\n" % (len(quoted) + 1, quoted.encode()), entry(6))
    fresh = GrowingReader(options)  # restarted: it looks on from the committed offsets
    assert fresh.known == end
    rows, end = batches(fresh, end)
    assert [r["raw"].split(b"\n")[0] for r in rows] == [b"Subject: m4", b"Subject: m5"] and b"From me\ny" in rows[1]["raw"]
    still = GrowingReader(options | {"idle": "0"})
    rows, end = batches(still, end)
    assert [r["raw"].split(b"\n")[0] for r in rows] == [b"Subject: m6"] and end == {str(box): os.path.getsize(box)}
    assert batches(still, end)[0] == []
    other = box.parent / "Sent.mbox"
    grow(other, entry(7))
    rows, end = batches(still, end)
    assert [r["path"] for r in rows] == [str(other)]
    box.write_bytes(entry(8))  # written anew
    assert [r["raw"].split(b"\n")[0] for r in batches(still, end)[0]] == [b"Subject: m8"]


def test_a_restarted_stream_reads_nothing_twice(spark, tmp_path):
    box, out, check = tmp_path / "mail" / "Inbox.mbox", f"file://{tmp_path}/out", f"file://{tmp_path}/check"
    box.parent.mkdir()

    def run(until: int):
        rows = appended(spark, f"file://{box.parent}", idle=0, state=f"file://{tmp_path}/state").select("folder", "nid", "offset", F.decode("raw", "utf-8").alias("raw"))
        q = rows.writeStream.format("parquet").option("checkpointLocation", check).start(out)
        try:
            for _ in range(60):
                q.processAllAvailable()
                if spark.read.schema("folder string, nid long, offset long, raw string").parquet(out).count() >= until:
                    break
                time.sleep(1)
        finally:
            q.stop()
        return spark.read.parquet(out).orderBy("offset").collect()

    grow(box, *[entry(i) for i in range(5)])
    assert len(run(5)) == 5
    grow(box, *[entry(i) for i in range(5, 12)])
    rows = run(12)
    assert [r["raw"].split("\n")[0] for r in rows] == [f"Subject: m{i}" for i in range(12)] and {r["folder"] for r in rows} == {"Inbox"} and len({r["nid"] for r in rows}) == 12
