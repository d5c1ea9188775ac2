"""WARC archives of web pages, and a two-level capture index over them.

Writing. A pass over digests alone settles which page of equal payloads is the response (that of the largest page_id,
then url) and which revisit it; payloads aren't shuffled while the digests of repeated payloads are few enough for a
checked broadcast. Each task then writes its records, one gzip member each, into archives under a name of its own and
returns their captures. Captures are written by Spark, so only those of committed attempts count: an archive that a lost
task has left is named by none, and `sweep` deletes it.

Index. Captures are sorted by their key, the URL with its host reversed (`com,example,www)/path?query`), by ranges; each
range is one file of compressed blocks of BLOCK lines, with a sparse directory of the blocks' first keys at its end. The
parts table (a row a file: its first and last key) is the upper level. A lookup finds a key's files and blocks by binary
search in both, reads these byte ranges, and then the byte ranges of the records; a key of very many captures is many
blocks, which are dealt over tasks.

Null html counts as empty, a null page_id is the smallest, a null url has an empty key. Rows that repeat page_id, url and
payload are one response and revisits to it. Bytes that no URI may hold (blanks, controls, beyond ASCII) are
percent-encoded in URIs and keys; payloads are bytes, so invalid UTF-8 stays as it is. Digests are checked on reading.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked, new_path, prepare, settle

#: Lines of a block, bytes at which an archive is full, zlib's level, copies of one row that a task writes out.
BLOCK, ROLL, LEVEL, COPIES = 3000, 1 << 30, 4, 1 << 16
#: Open archives, and directories or blocks of the index, that a task keeps.
ARCHIVES, KEPT = 64, 8
DATE = "2024-01-01T00:00:00Z"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "key string, page_id long, kind string, digest string, bytes long, file string, at long, size long"
RECORD = "key string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_URL = re.compile(rb"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#]*)([^#]*)", re.S)
_UNSAFE = re.compile(rb"[^\x21-\x7e]")


def escaped(url: bytes) -> bytes:
    return _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], url)


def sort_key(url: bytes | None) -> str:
    """The URL without scheme, user, default port and fragment, its host in reverse; other texts as they are."""
    if not url:
        return ""
    m = _URL.match(url)
    if not m:
        return escaped(url).decode()
    host = re.sub(rb":(?:80|443)?$", b"", m[1].lower())
    name, colon, port = host.partition(b":") if not host.startswith(b"[") else (host, b"", b"")
    return escaped(b",".join(name.rstrip(b".").split(b".")[::-1]) + colon + port + b")" + (m[2] if m[2].startswith(b"/") else b"/" + m[2])).decode()


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _uri(page_id: int | None, digest: str, copy: int, url: bytes) -> bytes:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}:{copy}:{zlib.crc32(url):08x}>".encode()


def record(kind: str, headers: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    lines = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), *[k + b": " + v for k, v in headers], b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: bytes, digest: str, size: int, payload: bytes | None, copy: int, refers_to: int | None, refers_url: bytes) -> tuple[str, bytes]:
    """A response, or without a payload a revisit of the page referred to."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    headers = [(b"WARC-Record-ID", _uri(page_id, digest, copy, url)), (b"WARC-Date", DATE.encode()), (b"WARC-Target-URI", escaped(url)), (b"WARC-Payload-Digest", b"sha1:" + digest.encode()), (b"Content-Type", b"application/http; msgtype=response")]
    if payload is not None:
        return "response", record("response", headers, http + payload)
    refers = [(b"WARC-Profile", PROFILE), (b"WARC-Refers-To", _uri(refers_to, digest, 0, refers_url)), (b"WARC-Refers-To-Target-URI", escaped(refers_url))]
    return "revisit", record("revisit", headers + refers, http)


def parsed(data: bytes) -> tuple[dict[str, bytes], bytes]:
    """Headers (names in lower case) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower().decode("latin-1"): v.strip() for k, _, v in (x.partition(b":") for x in lines[1:])}
    n = int(fields["content-length"])
    if len(rest) < n + 4:
        raise ValueError("a WARC record is cut off")
    return fields, rest[:n]


def _page(uri: bytes) -> int | None:
    text = uri.decode()[len("<urn:page:") :].partition(":")[0]
    return int(text) if text else None


def page_row(data: bytes) -> dict | None:
    """The page of a record and its payload, whose digest is checked; None for records of other types."""
    fields, block = parsed(data)
    kind = fields.get("warc-type", b"").decode()
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\ncontent-length: *(\d+)", http)[1])
    digest = fields["warc-payload-digest"].removeprefix(b"sha1:").decode()
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"the payload of {fields['warc-record-id'].decode()} doesn't match its digest")
    url = fields["warc-target-uri"]
    return {
        "key": sort_key(url), "page_id": _page(fields["warc-record-id"]), "url": url.decode(), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": _page(fields["warc-refers-to"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None,
    }


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, digest (hex), bytes, payload (null for revisits), copy, refers_to, refers_url: one row a page.

    least: payloads of fewer bytes are all responses.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    url = F.coalesce(F.col("url").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), payload.alias("payload")).withColumns({"digest": F.unhex(F.sha1("payload")), "bytes": F.octet_length("payload").cast("long")})
    groups = settle(rows.groupBy("digest", "bytes", "page_id", "url").agg(F.count("*").alias("n")))
    large = groups.where(F.col("bytes") >= least).groupBy("digest").agg(F.sum("n").alias("all"), F.max(F.struct("page_id", "url", "n")).alias("first")).where(F.col("all") > 1)
    repeated = settle(large.select("digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url"), (F.col("first.n") > 1).alias("again")))
    repeated = checked(repeated)
    is_first = F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("url").eqNullSafe(F.col("refers_url"))
    # Revisits need no payload: they come from the counts.
    copies = groups.join(repeated, "digest").withColumn("copies", F.col("n") - is_first.cast("long")).where("copies > 0")
    copies = copies.withColumn("from", F.explode(F.sequence(F.lit(1).cast("long"), "copies", F.lit(COPIES).cast("long"))))
    most = groups.agg(F.max("n")).first()[0] or 0
    copies = copies.repartition("digest", "page_id", "url", "from") if most > COPIES else copies
    copies = copies.withColumn("copy", F.explode(F.sequence("from", F.least(F.col("from") + COPIES - 1, F.col("copies")))))
    columns = ["page_id", "url", "digest", "bytes", "payload", "copy", "refers_to", "refers_url"]
    revisits = copies.withColumn("payload", F.lit(None).cast("binary")).select(columns)
    known = rows.join(repeated, "digest", "left").where(F.col("again").isNull() | is_first).withColumn("copy", F.lit(0).cast("long"))
    responses = known.where("not coalesce(again, false)").select(columns)
    if most > 1:  # of a first row that stands several times, one
        responses = responses.unionByName(known.where("again").dropDuplicates(["digest"]).select(columns))
    return responses.unionByName(revisits)


def write(pages: DataFrame, path: str, least: int = 0) -> DataFrame:
    """Write the archives under the path; their captures, settled."""
    spark = prepare(pages.sparkSession)
    folder = f"{path}/archives"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, base = _system(folder)
        system.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    if out is None or at >= ROLL:
                        if out:
                            out.close()
                        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                        out = system.open_output_stream(f"{base}/{name}", compression=None)
                        info = _member(record("warcinfo", [(b"WARC-Record-ID", b"<urn:uuid:%s>" % str(uuid.uuid4()).encode()), (b"WARC-Date", DATE.encode()), (b"WARC-Filename", name.encode()), (b"Content-Type", b"application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                        out.write(info)
                        at = len(info)
                    digest = base64.b32encode(r["digest"]).decode()
                    kind, data = page_record(r["page_id"], r["url"], digest, r["bytes"], r["payload"], r["copy"], r["refers_to"], r["refers_url"])
                    data = _member(data)
                    out.write(data)
                    rows.append((sort_key(r["url"]), r["page_id"], kind, digest, r["bytes"], name, at, len(data)))
                    at += len(data)
                if rows:
                    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "page_id", "kind", "digest", "bytes", "file", "at", "size"])
        finally:
            if out:
                out.close()

    target = f"{path}/captures"
    records(pages, least).mapInArrow(put, CAPTURE).write.parquet(target)
    return spark.read.schema(CAPTURE).parquet(target)


def sweep(spark: SparkSession, path: str) -> int:
    """Delete archives that no capture names, left by lost tasks; how many. Archives are as many as tasks, or one a ROLL bytes."""
    from pyarrow import fs

    named = {r["file"] for r in spark.read.schema(CAPTURE).parquet(f"{path}/captures").select("file").distinct().collect()}
    system, base = _system(f"{path}/archives")
    found = [x for x in system.get_file_info(fs.FileSelector(base, allow_not_found=True)) if x.is_file and x.base_name not in named]
    for x in found:
        system.delete_file(x.path)
    return len(found)


def _line(r: dict) -> bytes:
    page = "" if r["page_id"] is None else r["page_id"]
    return f"{r['key']} {page} {r['kind']} {r['digest']} {r['bytes']} {r['file']} {r['at']} {r['size']}\n".encode()


PART = "first string, last string, file string, directory_at long, directory_size long, blocks long, lines long"


def build_index(captures: DataFrame, path: str, block: int = BLOCK) -> DataFrame:
    """Write blocks and directories under the path; the parts table, a row a file (a file a task)."""
    folder = f"{path}/index"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, at, directory, held, first, last, total = None, 0, [], [], "", "", 0
        system, base = _system(folder)

        def flush() -> None:
            nonlocal at
            data = zlib.compress(b"".join(_line(r) for r in held), LEVEL)
            out.write(data)
            directory.append(f"{held[0]['key']} {at} {len(data)}\n")
            at += len(data)
            held.clear()

        try:
            for batch in batches:
                for r in batch.to_pylist():
                    if out is None:
                        system.create_dir(base, recursive=True)
                        name, first = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.cdx", r["key"]
                        out = system.open_output_stream(f"{base}/{name}", compression=None)
                    held.append(r)
                    last, total = r["key"], total + 1
                    if len(held) == block:
                        flush()
            if out is not None:
                if held:
                    flush()
                data = zlib.compress("".join(directory).encode(), LEVEL)
                out.write(data + struct.pack("<QQ", at, len(data)))
                yield pa.RecordBatch.from_pydict({"first": [first], "last": [last], "file": [name], "directory_at": [at], "directory_size": [len(data)], "blocks": [len(directory)], "lines": [total]})
        finally:
            if out:
                out.close()

    order = ["key", F.asc_nulls_first("page_id"), "file", "at"]
    target = f"{path}/parts"
    captures.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(put, PART).write.parquet(target)
    return captures.sparkSession.read.schema(PART).parquet(target)


class Kept:
    """The most recently used of what is opened or read."""

    def __init__(self, make, most: int = KEPT):
        self.make, self.most, self.held = make, most, OrderedDict()

    def __call__(self, key):
        if key in self.held:
            self.held.move_to_end(key)
            return self.held[key]
        if len(self.held) >= self.most:
            self.held.popitem(last=False)
        self.held[key] = self.make(key)
        return self.held[key]


def blocks_of(key: str, firsts: list[str]) -> range:
    """The blocks that may hold a key, by their first keys."""
    return range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key))


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The captures of all keys in `keys` (column key), by binary search and range reads in the index alone."""
    # One row a file of the index, of which there are as many as the writing stage had tasks.
    parts = sorted(tuple(r) for r in spark.read.schema(PART).parquet(f"{path}/parts").select("first", "last", "file", "directory_at", "directory_size").collect())
    firsts, lasts, folder = [p[0] for p in parts], [p[1] for p in parts], f"{path}/index"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _system(folder)

        def directory(i: int) -> tuple[list[str], list[tuple[int, int]]]:
            _, _, file, at, size = parts[i]
            with system.open_input_file(f"{base}/{file}") as f:
                entries = [x.split(" ") for x in zlib.decompress(f.read_at(size, at)).decode().splitlines()]
            return [e[0] for e in entries], [(int(e[1]), int(e[2])) for e in entries]

        read = Kept(directory)
        for batch in batches:
            rows = []
            for key in sorted(batch["key"].to_pylist()):
                for i in range(bisect_left(lasts, key), bisect_right(firsts, key)):
                    begins, places = read(i)
                    rows += [(parts[i][2], *places[b], key) for b in blocks_of(key, begins)]
                    if len(rows) >= 1 << 14:
                        yield _table(rows)
                        rows = []
            if rows:
                yield _table(rows)

    def _table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["part", "block_at", "block_size", "key"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _system(folder)

        def lines(block: tuple[str, int, int]) -> tuple[list[str], list[list[str]]]:
            with system.open_input_file(f"{base}/{block[0]}") as f:
                rows = [x.split(" ") for x in zlib.decompress(f.read_at(block[2], block[1])).decode().splitlines()]
            return [r[0] for r in rows], rows

        read = Kept(lines)
        for batch in batches:
            found = []
            for file, at, size, key in zip(*[batch[c].to_pylist() for c in ("part", "block_at", "block_size", "key")], strict=True):
                names, rows = read((file, at, size))
                found += rows[bisect_left(names, key) : bisect_right(names, key)]
                if len(found) >= 1 << 14:
                    yield _captures(found)
                    found = []
            if found:
                yield _captures(found)

    def _captures(rows: list[list[str]]) -> pa.RecordBatch:
        key, page, kind, digest, size, file, at, length = zip(*rows, strict=True)
        whole = lambda c: pa.array([int(v) if v else None for v in c], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(key), whole(page), pa.array(kind), pa.array(digest), whole(size), pa.array(file), whole(at), whole(length)], names=["key", "page_id", "kind", "digest", "bytes", "file", "at", "size"])

    distinct = keys.select("key").where("key is not null").distinct()
    # Neighbouring keys stand together, so a task opens few directories; then each block is one task's.
    found = distinct.repartitionByRange("key").mapInArrow(find, "part string, block_at long, block_size long, key string")
    return found.repartition("part", "block_at").sortWithinPartitions("part", "block_at").mapInArrow(scan, CAPTURE)


def read_records(path: str, captures: DataFrame, payloads: bool = False) -> DataFrame:
    """The pages of captures, each by one range read of its archive."""
    folder = f"{path}/archives"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _system(folder)
        archive = Kept(lambda name: system.open_input_file(f"{base}/{name}"), ARCHIVES)
        for batch in batches:
            places = sorted(zip(batch["file"].to_pylist(), batch["at"].to_pylist(), batch["size"].to_pylist(), strict=True))
            for lo in range(0, len(places), 256):
                yield _pages([page_row(zlib.decompress(archive(f).read_at(n, at), 31)) for f, at, n in places[lo : lo + 256]], payloads)

    return captures.select("file", "at", "size").mapInArrow(read, RECORD + (", payload binary" if payloads else ""))


def _pages(rows: list[dict], payloads: bool) -> pa.RecordBatch:
    kinds = [("key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    kinds += [("payload", pa.binary())] if payloads else []
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in kinds], names=[c for c, _ in kinds])


def scan(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The pages of all archives under a folder, read from end to end without an index; a task reads whole archives."""
    from pyarrow import fs

    system, base = _system(path)
    names = [x.path for x in system.get_file_info(fs.FileSelector(base)) if x.is_file and x.path.endswith(".warc.gz")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _system(path)
        for batch in batches:
            for name in batch["name"].to_pylist():
                with system.open_input_stream(name, compression=None) as f:
                    rows, unzip, data = [], zlib.decompressobj(31), b""
                    while more := unzip.unused_data or f.read(1 << 20):
                        if unzip.eof:
                            unzip = zlib.decompressobj(31)
                        data += unzip.decompress(more)
                        if unzip.eof:
                            rows += [r for r in [page_row(data)] if r]
                            data = b""
                        if len(rows) >= 256:
                            yield _pages(rows, payloads)
                            rows = []
                    if data:
                        raise ValueError(f"{name} is cut off")
                    if rows:
                        yield _pages(rows, payloads)

    files = spark.createDataFrame([(n,) for n in names], "name string").repartition(max(1, len(names)))
    return files.mapInArrow(read, RECORD + (", payload binary" if payloads else ""))


def keys_of(pages: DataFrame) -> DataFrame:
    """The key of each page's URL."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"key": pa.array([sort_key(u) for u in batch["url"].to_pylist()], pa.string())})

    return pages.select(F.col("url").cast("binary").alias("url")).mapInArrow(make, "key string")


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archive all pages, look their URLs up in the index, and read what it names."""
    spark = prepare(pages.sparkSession)
    path = new_path(spark, "warc")
    build_index(write(pages, path, least), path)
    return read_records(path, lookup(spark, path, keys_of(pages)))


def oracle(least: int = 0) -> str:
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    # Base32 takes five bits at a time: those from bit 5 i on lie in three hexadecimal digits.
    base32 = f"array_to_string(list_transform(range(32), lambda i: substr('{alphabet}', CAST((('0x' || substr(h || '00', 5 * i // 4 + 1, 3))::BIGINT >> (7 - 5 * i % 4)) & 31 AS INTEGER) + 1, 1)), '')"
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h FROM p),
        b AS (SELECT page_id, n AS payload_bytes, {base32} AS payload_digest, max(page_id) OVER (PARTITION BY h) AS first FROM d)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = first OR payload_bytes < {least} THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first AND payload_bytes >= {least} THEN first END AS refers_to FROM b"""
