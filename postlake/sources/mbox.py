"""A Spark data source for mbox files: format("mbox"), options path, splitBytes and content.

A message begins at a line `From ` at the start of the file or after an empty line. A believable Content-Length
(it ends a line, and a separator or the end of the file follows) says where a message ends; separators before that
place belong to its text. A file is cut into byte ranges of splitBytes, read in parallel: a range holds the messages
that begin in it and reads past its end to finish the last one. The reader of a range can't know whether a message of
an earlier range covers a separator, so it gives every separator with the place where its message would end, and
`read_mbox` settles all of them by these places. A file of one range is settled by its reader, by the same rule.

content: `full` messages, `head` for their header blocks, `none` for the places of the separators in files of
several ranges only.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .tree import BYTES, END_OF_HEAD, MARK, PLACE, ROWS, listed

SCHEMA = "path string, number long, offset long, end long, size long, raw binary"
READ, SPLIT, FILES = 1 << 20, 256 << 20, 500
SEPARATOR = re.compile(rb"\n\r?\nFrom ")
#: Rows that are broadcast at most.
SMALL = 1 << 16


def may_be_mbox(path: str) -> bool:
    """Whether a file is worth a look: no extension or an mbox's, inside a `.sbd` folder, or a part that `write_mbox` wrote."""
    folder, name = os.path.split(path.lower())
    return "." not in name or name.endswith((".mbox", ".mbx")) or "/folder=" in folder and name.startswith("part-") or folder.endswith(".sbd") and not name.endswith(".msf")


class Text:
    """A file's bytes from some place on, read as far as needed; what lies before the place in use is dropped."""

    def __init__(self, f, at: int):
        self.f, self.base, self.data, self.more = f, at, b"", True
        f.seek(at)

    def fill(self, keep: int) -> bool:
        """Read on, the more the longer the message, and drop what lies before keep."""
        chunk = self.f.read(max(READ, len(self.data))) if self.more else b""
        self.more = bool(chunk)
        self.data, self.base = self.data[max(0, keep - self.base) :] + chunk, max(self.base, min(keep, self.base + len(self.data)))
        return self.more

    def search(self, pattern: re.Pattern, at: int, keep: int, back: int) -> re.Match | None:
        """The first match from at on; back: how far a match may reach over what has been read."""
        while (m := pattern.search(self.data, at - self.base)) is None:
            at = max(at, self.base + len(self.data) - back)
            if not self.fill(keep):
                return None
        return m

    def separator(self, at: int, keep: int) -> int:
        """The place of the next separator line after an empty line that ends after at, or that of the end of the file."""
        m = self.search(SEPARATOR, at, keep, 8)
        return self.base + m.end() - 5 if m else self.base + len(self.data)

    def slice(self, a: int, b: int) -> bytes:
        return self.data[a - self.base : b - self.base]


def stated_end(text: Text, body: int, size: int) -> int | None:
    """Where the next separator (or the end of the file) is by a believable Content-Length of the message at body."""
    m = text.search(re.compile(rb"(?:\A|\n)\r?\n"), body - 1, body - 1, 3)
    if m is None:
        return None
    head = text.base + m.end()
    n = re.search(rb"(?im)^content-length:[ \t]*(\d{1,18})[ \t]*\r?$", text.slice(body, head))
    last = head + int(n[1]) if n else size + 1
    if last > size:
        return None
    here = text.f.tell()
    text.f.seek(last - 1)
    tail = text.f.read(4096)
    text.f.seek(here)
    blank = re.match(rb"(?:\r?\n)*", tail[1:]).end()
    if int(n[1]) and tail[:1] != b"\n" or tail[1 + blank :] and not tail[1 + blank :].startswith(b"From "):
        return None
    return last + blank


def messages(f, start: int, end: int, size: int, whole: bool, content: str = "full") -> Iterator[tuple[int, int, int, bytes]]:
    """(place, end, size, bytes) of the message behind each separator in start..end; whole: without those that another covers.

    content: whole messages (`full`), their header blocks (`head`) or nothing of them (`none`).
    """
    text = Text(f, max(0, start - 3))
    text.fill(0)
    at = 0 if start == 0 and text.data.startswith(b"From ") else text.separator(text.base, text.base)
    if at < start:  # the range before has this one
        at = text.separator(at, at)
    while at < min(end, size):
        m = text.search(re.compile(rb"\n"), at, at, 0)
        body = text.base + m.end() if m else size
        stated = stated_end(text, body, size) if m else None
        following = text.separator(body - 1, at) if stated is None or not whole else stated
        stop = following if stated is None else stated
        while text.base + len(text.data) < stop and text.fill(at):
            pass
        raw = text.slice(body, stop)
        if raw.endswith((b"\n\n", b"\n\r\n")):  # the empty line before the next separator isn't the message's
            raw = raw[: -2 if raw.endswith(b"\r\n") else -1]
        if content != "full":
            head = END_OF_HEAD.search(raw) if content == "head" else None
            yield at, stop, len(raw), b"" if content == "none" else raw[: head.end()] if head else raw
        else:
            yield at, stop, len(raw), raw
        at = following


@dataclass
class Ranges(InputPartition):
    uri: str
    #: path, place in the listing, size, start, end
    parts: list


class MboxReader(DataSourceReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.uri, self.split, self.content = options["path"], int(options.get("splitbytes", SPLIT)), options.get("content", "full")

    def partitions(self) -> list[Ranges]:
        out, some, held = [], [], 0
        for number, (path, _, size) in enumerate(listed(self.uri)[1]):
            if not size or not may_be_mbox(path) or self.content == "none" and size <= self.split:
                continue
            if size > self.split:
                out += [Ranges(self.uri, [(path, number, size, a, min(a + self.split, size))]) for a in range(0, size, self.split)]
                continue
            if held + size > self.split or len(some) == FILES:
                out.append(Ranges(self.uri, some))
                some, held = [], 0
            some.append((path, number, size, 0, size))
            held += size
        return [*out, Ranges(self.uri, some)] if some or not out else out

    def read(self, part: Ranges) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(part.uri)
        rows, held = [], 0
        for path, number, size, start, end in part.parts:
            with system.open_input_file(path) as f:
                if f.read(MARK) != b"From ":
                    continue
                for at, stop, length, raw in messages(f, start, end, size, size <= self.split, self.content):
                    rows.append((path, number, at, stop, length, raw))
                    held += len(raw)
                    if len(rows) == ROWS or held >= BYTES:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), *[pa.int64()] * 4, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "number", "offset", "end", "size", "raw"])


class MboxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MboxReader:
        return MboxReader(dict(self.options))


def covered(spans: DataFrame, split: int) -> DataFrame:
    """(path, offset) of separators that lie in the text of another message; spans: path, offset, end of every separator.

    A separator that no earlier span reaches over is a message for sure. Those that one reaches over are walked through
    together with the sure one before them: a message covers what begins before its end, and what is covered covers
    nothing. Running maxima are taken within ranges and carried over from range to range, so that no file is one task.
    """
    spans = spans.withColumn("range", F.floor(F.col("offset") / split))
    earlier, within = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("path", "range").orderBy("offset")

    def carried(rows: DataFrame, value: str, into: str, upto: int) -> DataFrame:
        """The largest value of earlier separators (upto -1) or of those and this one (0)."""
        totals = rows.groupBy("path", "range").agg(F.max(value).alias("_top")).withColumn("_top", F.max("_top").over(earlier))  # a row a range
        here = F.max(value).over(within.rowsBetween(Window.unboundedPreceding, upto))
        return rows.join(totals, ["path", "range"]).withColumn(into, F.greatest(here, "_top")).drop("_top")

    spans = carried(spans, "end", "reach", -1)
    spans = spans.withColumn("sure", F.coalesce(F.col("offset") >= F.col("reach"), F.lit(True))).withColumn("start", F.when(F.col("sure"), F.col("offset")))
    spans = carried(spans, "start", "head", 0)
    doubtful = spans.where("not sure").select("path", "head").distinct()
    # A group is what one message's stated length reaches over, and what hangs on to that.
    chains = spans.join(doubtful, ["path", "head"], "left_semi").groupBy("path", "head").agg(F.array_sort(F.collect_list(F.struct("offset", "end"))).alias("all"))
    none = F.struct(F.lit(0).cast("long").alias("until"), F.array().cast("array<long>").alias("out"))
    walk = F.aggregate("all", none, lambda s, x: F.when(x["offset"] < s["until"], F.struct(s["until"].alias("until"), F.concat(s["out"], F.array(x["offset"])).alias("out"))).otherwise(F.struct(x["end"].alias("until"), s["out"].alias("out"))))
    return chains.select("path", F.explode(walk["out"]).alias("offset"))


def read_mbox(spark: SparkSession, path: str, split_bytes: int = SPLIT, head_only: bool = False) -> DataFrame:
    """Raw messages of all mbox files at the path, in the shape that `mime.messages` and `mime.heads` take."""
    spark.dataSource.register(MboxSource)
    load = lambda content: spark.read.format("mbox").option("splitBytes", split_bytes).option("content", content).load(path)
    rows = load("head" if head_only else "full")
    if any(size > split_bytes and may_be_mbox(p) for p, _, size in listed(path)[1]):
        out = covered(load("none").select("path", "offset", "end"), split_bytes).persist()
        rows = rows.join(F.broadcast(out) if out.count() <= SMALL else out, ["path", "offset"], "left_anti")
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"(?i)\.(mbox|mbx)$", "")
    nested = F.regexp_replace(F.regexp_extract("path", r"((?:[^/]+\.sbd/)+)[^/]+$", 1), r"\.sbd/", "/")
    packages = F.filter(F.split("path", "/"), lambda c: F.endswith(c, F.lit(".mbox")))
    package = F.array_join(F.transform(packages, lambda c: F.regexp_replace(c, r"\.mbox$", "")), "/")
    folder = F.when(F.col("path").rlike(r"\.mbox/mbox$"), package).otherwise(F.concat(nested, name))
    nid = F.shiftleft(F.col("number"), PLACE) + F.col("offset")
    return rows.select(F.element_at(F.split(F.lit(path.rstrip("/")), "/"), -1).alias("source_name"), folder.alias("folder"), nid.alias("nid"), F.lit("mbox").alias("kind"), "raw", F.lit(None).cast("boolean").alias("flag_read"), "size", F.lit(None).cast("string").alias("error"), "path", "offset")
