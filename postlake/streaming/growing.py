"""A stream of the messages that are appended to mbox files: readStream.format("mboxstream"), options path, idle and state.

The offset is a byte of each file, always one where a message begins or the file ends; a batch is what lies between two
offsets, so a replayed batch gives the same messages, and nothing is read from its beginning again. Where messages
begin is settled by the rule of `mbox` (a stated length covers what looks like a separator), over the new bytes only.
The last message of a file counts once another follows it or the file has been still for `idle` seconds. A file that got
shorter has been written anew and is read from its start. state: a folder for the offsets of committed batches, from where
a restarted stream looks on (without it the first look goes over whole files; Spark's checkpoint decides what is read).
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.mbox import may_be_mbox, messages
from ..sources.tree import BYTES, MARK, ROWS, listed

SCHEMA = "path string, offset long, end long, size long, raw binary"
IDLE = 60.0


@dataclass
class Span(InputPartition):
    uri: str
    path: str
    start: int
    end: int


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.uri, self.idle, self.state = options["path"], float(options.get("idle", IDLE)), options.get("state")
        self.known: dict[str, int] = self._stored()

    def _stored(self) -> dict[str, int]:
        from pyarrow import fs

        if not self.state:
            return {}
        system, base = fs.FileSystem.from_uri(f"{self.state}/offsets.json")
        if not system.get_file_info(base).is_file:
            return {}
        with system.open_input_stream(base) as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The end of the last whole message of each file."""
        system, found = listed(self.uri)
        out = dict(self.known)
        for path, changed, size in found:
            if not size or not may_be_mbox(path):
                continue
            start = out.get(path, 0) if out.get(path, 0) <= size else 0
            still = changed is None or time.time() - changed / 1e6 >= self.idle
            with system.open_input_file(path) as f:
                if start < size and (start or f.read(MARK) == b"From "):
                    for _, stop, _, _ in messages(f, start, size, size, True, "none"):
                        if stop < size or still:
                            start = stop
            out[path] = start
        self.known = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Span]:
        self.known = {p: max(n, self.known.get(p, 0)) for p, n in end.items()} | {p: n for p, n in self.known.items() if p not in end}
        spans = [Span(self.uri, p, start.get(p, 0) if start.get(p, 0) <= n else 0, n) for p, n in sorted(end.items()) if start.get(p, 0) != n]
        return spans or [Span(self.uri, "", 0, 0)]

    def read(self, part: Span) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        rows, held = [], 0
        if part.path and part.start < part.end:
            system, _ = fs.FileSystem.from_uri(part.uri)
            with system.open_input_file(part.path) as f:
                for at, stop, length, raw in messages(f, part.start, part.end, part.end, True):
                    rows.append((part.path, at, stop, length, raw))
                    held += len(raw)
                    if len(rows) == ROWS or held >= BYTES:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), *[pa.int64()] * 3, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "offset", "end", "size", "raw"])

    def commit(self, end: dict) -> None:
        from pyarrow import fs

        if self.state:
            system, base = fs.FileSystem.from_uri(self.state)
            system.create_dir(base, recursive=True)
            with system.open_output_stream(f"{base}/offsets.part") as out:
                out.write(json.dumps(end).encode())
            system.move(f"{base}/offsets.part", f"{base}/offsets.json")


class GrowingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mboxstream"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(dict(self.options))


def appended(spark: SparkSession, uri: str, idle: float = IDLE, state: str | None = None) -> DataFrame:
    """The messages appended to the mbox files at the place, in the shape that `mime.messages` takes.

    nid is the place of the separator in its file with a hash of the path above it: it stays while files come and go.
    """
    spark.dataSource.register(GrowingSource)
    stream = spark.readStream.format("mboxstream").option("path", uri).option("idle", idle)
    rows = (stream.option("state", state) if state else stream).load()
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"(?i)\.(mbox|mbx)$", "")
    nid = F.shiftleft(F.pmod(F.xxhash64("path"), F.lit(1 << 22)), 40) + F.col("offset")
    return rows.select(F.lit(uri.rstrip("/").rpartition("/")[2]).alias("source_name"), name.alias("folder"), nid.alias("nid"), F.lit("mbox").alias("kind"), "raw", F.lit(None).cast("boolean").alias("flag_read"), "size", F.lit(None).cast("string").alias("error"), "path", "offset")
