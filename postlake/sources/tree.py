"""A Spark data source for trees of small files: format("mailtree"), options path, content and filesPerTask.

It exists beside binaryFile because Maildir names hold colons, which Hadoop's paths refuse. The driver lists
names, as it does for any file source; contents are read in the tasks, and only as far as asked for: `true` for
whole files, `head` for a message's header block, `marks` for the first bytes of files without an extension, `false`
for none. A file that can't be read is a row with its reason in `error`.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, number long, modificationTime timestamp, length long, content binary, error string"
#: Bytes of a message that a listing reads at a time until its header block ends; bytes that tell an mbox.
HEAD, MARK = 16 << 10, 5
END_OF_HEAD = re.compile(rb"\r?\n\r?\n")
#: Bits of a message number that hold its place in the file (a terabyte); the file's place in the listing is above them.
PLACE = 40
#: Rows and bytes of a batch.
ROWS, BYTES = 512, 8 << 20


def listed(uri: str) -> tuple:
    """The file system, and (path, microseconds of change, size) of every file at or under the place, in order of path.

    A folder is listed once, so links that lead back to it end nowhere.
    """
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(uri)
    found = [system.get_file_info(base)]
    if found[0].type != fs.FileType.File:
        if isinstance(system, fs.LocalFileSystem):
            found, waiting, seen = [], [base], set()
            while waiting:
                folder = waiting.pop()
                if (real := os.path.realpath(folder)) not in seen:
                    seen.add(real)
                    for f in system.get_file_info(fs.FileSelector(folder)):
                        waiting.append(f.path) if f.type == fs.FileType.Directory else found.append(f)
        else:
            found = system.get_file_info(fs.FileSelector(base, recursive=True))
    return system, sorted((f.path, f.mtime_ns // 1000 if f.mtime_ns else None, f.size) for f in found if f.type == fs.FileType.File)


def head_of(f) -> bytes:
    """The header block of a message, however long it is."""
    data = b""
    while more := f.read(max(HEAD, len(data))):
        at = max(0, len(data) - 3)
        data += more
        if END_OF_HEAD.search(data, at):
            break
    return data


@dataclass
class Files(InputPartition):
    uri: str
    first: int
    entries: list


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.uri, self.content, self.each = options["path"], options.get("content", "true"), int(options.get("filespertask", 2000))

    def partitions(self) -> list[Files]:
        found = listed(self.uri)[1]
        return [Files(self.uri, i, found[i : i + self.each]) for i in range(0, len(found), self.each)]

    def _content(self, system, path: str) -> bytes | None:
        if self.content == "false" or self.content == "marks" and "." in os.path.basename(path):
            return None
        with system.open_input_stream(path) as f:
            return f.read() if self.content == "true" else f.read(MARK) if self.content == "marks" else head_of(f)

    def read(self, part: Files) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(part.uri)
        rows, size = [], 0
        for i, (path, changed, length) in enumerate(part.entries):
            data = error = None
            try:
                data = self._content(system, path)
            except OSError as e:
                error = str(e)
            rows.append((path, part.first + i, changed, length, data, error))
            size += len(data or b"")
            if len(rows) == ROWS or size >= BYTES:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.int64(), pa.binary(), pa.string())
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["path", "number", "modificationTime", "length", "content", "error"])


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mailtree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def read_tree(spark: SparkSession, root: str, content: str = "true") -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format("mailtree").option("content", content).load(root)
