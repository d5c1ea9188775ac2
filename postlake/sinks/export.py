"""Exports of very many files that take effect once, whatever tasks are lost on the way.

`rows.write.format("mailfiles")` stages: each task writes its files under a folder of its own attempt, with a list of
what it wrote and what it couldn't, and the commit writes one file that names the attempts that count; an abort deletes
the stage. Publishing then moves each attempt's files to their places, a rename a file inside the tasks, so a file is
there as a whole or not at all; a move that a lost task has done already is left as it is. Until the stage is gone a
publication can be taken up again. The log holds a row a file, with the reason where a message couldn't be written.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

LOG = "path string, size long, error string"


def _system(root: str):
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root)
    return system, base.rstrip("/")


def staged_at(base: str, job: str) -> str:
    return f"{base}/.staged-{job}"


def _safe(path: str) -> str:
    """A relative path that stays below the root."""
    parts = posixpath.normpath(path).split("/")
    if path.startswith("/") or ".." in parts or parts in ([""], ["."]):
        raise ValueError(f"not a path below the export's folder: {path}")
    return "/".join(parts)


@dataclass
class Staged(WriterCommitMessage):
    attempt: str
    files: int
    failed: int
    size: int


class ExportWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.root, self.job = options["path"], options["job"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        """Stage the files of one task; a message that can't be written is a line of the list, not the end."""
        system, base = _system(self.root)
        attempt = uuid.uuid4().hex
        folder, lines, n, size = f"{staged_at(base, self.job)}/{attempt}", [], 0, 0
        system.create_dir(folder, recursive=True)
        for batch in iterator:
            for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                try:
                    if path is None or not content.is_valid:
                        raise ValueError("no path" if path is None else "no content")
                    place, data = _safe(path), content.as_buffer()
                    with system.open_output_stream(f"{folder}/{n}") as out:
                        out.write(data)
                    lines.append({"path": place, "file": str(n), "size": data.size, "error": None})
                    size += data.size
                except (OSError, ValueError) as e:
                    lines.append({"path": path, "file": None, "size": None, "error": f"{type(e).__name__}: {e}"})
                n += 1
        with system.open_output_stream(f"{folder}/list") as out:
            out.write("".join(json.dumps(x) + "\n" for x in lines).encode())
        failed = sum(x["error"] is not None for x in lines)
        return Staged(attempt, n - failed, failed, size)

    def commit(self, messages: list[Staged | None]) -> None:
        """One file that names the attempts that count, put at its place by a rename."""
        system, base = _system(self.root)
        folder, whole = staged_at(base, self.job), [m for m in messages if m]
        system.create_dir(folder, recursive=True)
        text = json.dumps({"attempts": [m.attempt for m in whole], "files": sum(m.files for m in whole), "failed": sum(m.failed for m in whole), "size": sum(m.size for m in whole)})
        with system.open_output_stream(f"{folder}/committed.part") as out:
            out.write(text.encode())
        system.move(f"{folder}/committed.part", f"{folder}/committed.json")

    def abort(self, messages: list[Staged | None]) -> None:
        system, base = _system(self.root)
        from pyarrow import fs

        if system.get_file_info(staged_at(base, self.job)).type == fs.FileType.Directory:
            system.delete_dir(staged_at(base, self.job))


class ExportSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mailfiles"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> ExportWriter:
        return ExportWriter(dict(self.options))


def stage(rows: DataFrame, root: str, job: str | None = None) -> str:
    """Stage (path, content) for the root; the job's name, under which it can be published."""
    job = job or uuid.uuid4().hex
    rows.sparkSession.dataSource.register(ExportSource)
    rows.select("path", F.col("content").cast("binary").alias("content")).write.format("mailfiles").option("path", root).option("job", job).mode("append").save()
    return job


def committed(root: str) -> list[str]:
    """Jobs at the root that are staged as a whole and not published to the end."""
    from pyarrow import fs

    system, base = _system(root)
    found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
    jobs = [f.base_name.removeprefix(".staged-") for f in found if f.base_name.startswith(".staged-")]
    return [j for j in jobs if system.get_file_info(f"{staged_at(base, j)}/committed.json").is_file]


def publish(spark: SparkSession, root: str, job: str) -> DataFrame:
    """Move the files of a staged job to their places and write its log; the log's rows."""
    system, base = _system(root)
    folder = staged_at(base, job)
    with system.open_input_stream(f"{folder}/committed.json") as f:
        attempts = json.loads(f.read())["attempts"]  # as many as the job had tasks

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = _system(root)
        made: set[str] = set()
        for batch in batches:
            for attempt in batch["attempt"].to_pylist():
                own, rows = f"{staged_at(base, job)}/{attempt}", []
                with system.open_input_stream(f"{own}/list") as f:
                    entries = [json.loads(x) for x in f.read().splitlines()]
                for x in entries:
                    if x["error"] is None:
                        source, target = f"{own}/{x['file']}", f"{base}/{x['path']}"
                        try:
                            if (parent := posixpath.dirname(target)) not in made:
                                system.create_dir(parent, recursive=True)
                                made.add(parent)
                            if system.get_file_info(source).type == fs.FileType.File:
                                if not isinstance(system, fs.LocalFileSystem) and system.get_file_info(target).is_file:
                                    system.delete_file(target)  # where a rename doesn't replace
                                system.move(source, target)
                            elif not system.get_file_info(target).is_file:
                                raise FileNotFoundError(source)
                        except OSError as e:
                            x["error"] = f"{type(e).__name__}: {e}"
                    rows.append((x["path"], x["size"], x["error"]))
                kinds = (pa.string(), pa.int64(), pa.string())
                columns = zip(*rows, strict=True) if rows else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "size", "error"])

    log = f"{root.rstrip('/')}/export-log/{job}"
    listed = spark.createDataFrame([(a,) for a in attempts], "attempt string").repartition(max(1, len(attempts)))
    listed.mapInArrow(move, LOG).write.mode("overwrite").parquet(log)
    system.delete_dir(folder)
    return spark.read.schema(LOG).parquet(log)


def export(rows: DataFrame, root: str) -> DataFrame:
    """Write (path, content) below the root, whole files only; the log: path, size and error of every row."""
    return publish(rows.sparkSession, root, stage(rows, root))


def summary(log: DataFrame) -> DataFrame:
    """(exported, failed, size) of an export."""
    return log.agg(F.count_if(F.col("error").isNull()).alias("exported"), F.count("error").alias("failed"), F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col("size"))), F.lit(0)).alias("size"))


def log_lines(log: DataFrame) -> DataFrame:
    """The log as text: a line for each message that failed."""
    return log.where("error is not null").select(F.concat(F.coalesce("path", F.lit("(no path)")), F.lit(": "), "error").alias("line"))
