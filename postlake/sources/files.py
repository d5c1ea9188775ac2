"""Message files in directory trees: loose .eml and .emlx, Maildir, Apple Mail packages; and what lies where.

Files come from the `mailtree` source; kinds, folders and flags are expressions on the path. Looking for
sources reads no content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tree import PLACE, read_tree

MAILDIR = r"/(cur|new)/[^/]+$"
FLAGS = r"[:!;]2,([A-Za-z]*)$"
# First bytes of mail stores, old Office files and mboxes.
MAGIC = {b"!BDN": "pst", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1": "msg", b"From ": "mbox"}


def kind_of_file(path: str, head: bytes) -> str | None:
    """The kind of one file by its extension or else by how it begins; a header's first line makes it a message."""
    ext = path.rpartition("/")[2].lower().rpartition(".")
    if ext[1] and ext[2] in ("eml", "emlx", "msg", "mbox", "mbx", "pst", "ost"):
        return {"mbx": "mbox", "ost": "pst"}.get(ext[2], ext[2])
    return next((kind for magic, kind in MAGIC.items() if head.startswith(magic)), "eml" if re.match(rb"[A-Za-z][A-Za-z0-9-]*:[ \t]", head) else None)


def files(spark: SparkSession, root: str, content: str = "true") -> DataFrame:
    """Every file at or under the root with its kind; other files have kind null.

    With content `marks`, files without an extension that begin as an mbox does, or are empty beside a folder of their
    name and `.sbd`, are of kind mbox too.
    """
    rows = read_tree(spark, root, content)
    path = F.lower("path")
    plain = ~F.contains(F.element_at(F.split("path", "/"), -1), F.lit("."))
    if content == "marks":
        parents = rows.select(F.explode(F.regexp_extract_all("path", F.lit(r"^(.*?)\.sbd/"), F.lit(1))).alias("path")).distinct().withColumn("_parent", F.lit(True))
        rows = rows.join(parents, "path", "left").withColumn("_mbox", plain & ((F.col("content") == F.lit(b"From ")) | (F.col("length") == 0) & F.coalesce("_parent", F.lit(False)))).drop("_parent")
    else:
        rows = rows.withColumn("_mbox", F.lit(False))
    kind = (
        F.when(F.col("path").rlike(MAILDIR), "maildir").when(F.col("_mbox"), "mbox").when(F.endswith(path, F.lit(".emlx")), "emlx").when(F.endswith(path, F.lit(".eml")), "eml")
        .when(path.rlike(r"\.(mbox|mbx)$|\.mbox/mbox$|/mbox$|\.sbd/[^./]+$"), "mbox").when(path.rlike(r"\.(pst|ost)$"), "pst").when(F.endswith(path, F.lit(".msg")), "msg")
    )
    return rows.withColumn("kind", kind).drop("_mbox")


def find_sources(spark: SparkSession, root: str) -> DataFrame:
    """(kind, source, files, size, mtime): containers once each; loose message files are one source at the root."""
    rows = files(spark, root, "marks").select("path", "length", "modificationTime", "kind").where("kind is not null")
    base = F.lit(root.rstrip("/"))
    maildir = F.regexp_extract("path", r"^(.*?)(/\.[^/]+)?/(cur|new)/[^/]+$", 1)
    package = F.regexp_extract("path", r"^(.*?\.mbox)/", 1)
    source = F.when(F.col("kind") == "maildir", maildir).when(package != "", package).when(F.col("kind").isin("eml", "emlx", "msg"), base).otherwise(F.regexp_extract("path", r"^(.*?)(\.sbd/.*)?$", 1))
    kind = F.when(package != "", "mboxdir").when(F.col("kind").isin("eml", "emlx", "msg"), "files").otherwise(F.col("kind"))
    return rows.groupBy(kind.alias("kind"), source.alias("source")).agg(F.count("*").alias("files"), F.sum("length").alias("size"), F.max(F.unix_micros("modificationTime") / 1e6).alias("mtime"))


def read_files(spark: SparkSession, root: str, head_only: bool = False) -> DataFrame:
    """Raw messages of all message files at or under the root, in the shape that `mime.messages` and `mime.heads` take.

    Maildir: S is read, new mail is unread, T (trashed) and empty files are left out. Folders follow directories.
    head_only: no file is read beyond its header block. nid is the place in the listing, in the upper bits as for the
    messages of an mbox, so that both kinds of one listing share no number.
    """
    rows = files(spark, root, "head" if head_only else "true").where("length > 0")
    rows = rows.where("kind in ('maildir', 'eml', 'emlx')")
    flags = F.regexp_extract("path", FLAGS, 1)
    rows = rows.where(~((F.col("kind") == "maildir") & F.contains(flags, F.lit("T"))))
    read = F.when(F.col("kind") == "maildir", F.contains(flags, F.lit("S")) & F.contains("path", F.lit("/cur/")))
    base = root.rstrip("/").rpartition("/")[2]
    parent = F.concat(F.regexp_extract("path", r"^(.*)/[^/]+$", 1), F.lit("/"))
    below = F.when(F.contains(parent, F.lit(f"/{base}/")), F.substring_index(parent, f"/{base}/", -1)).otherwise("")
    folder = F.regexp_replace(F.regexp_replace(below, "/$", ""), r"(^|/)(cur|new)$", "")
    folder = F.regexp_replace(F.regexp_replace(folder, r"\.mbox(/Data.*|/Messages)?", ""), r"^\.", "")
    return rows.select(F.lit(base).alias("source_name"), folder.alias("folder"), F.shiftleft("number", PLACE).alias("nid"), "kind", F.col("content").alias("raw"), read.alias("flag_read"), F.col("length").alias("size"), "error", "path")


def contents(rows: DataFrame, root: str) -> DataFrame:
    """Listing rows with the whole bytes of their messages in `raw`, read in the tasks.

    rows: source_name, folder, nid, kind, flag_read, path, size, and for messages of an mbox the offset of their separator.
    """
    rows = rows if "offset" in rows.columns else rows.withColumn("offset", F.lit(None).cast("long"))
    rows = rows.select("source_name", "folder", "nid", "kind", "flag_read", F.col("size").cast("long").alias("size"), "path", "offset")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", raw binary, error string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                some, raw, errors = batch.slice(lo, 64), [], []
                for path, offset, size in zip(some["path"].to_pylist(), some["offset"].to_pylist(), some["size"].to_pylist(), strict=True):
                    try:
                        with system.open_input_file(path) as f:
                            if offset is None:
                                raw.append(f.read())
                            else:
                                f.seek(offset)
                                line = b""
                                while b"\n" not in line and (more := f.read(256)):
                                    line += more
                                f.seek(offset + line.find(b"\n") + 1)
                                raw.append(f.read(size))
                        errors.append(None)
                    except OSError as e:
                        raw.append(None)
                        errors.append(str(e))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(raw, pa.binary()), pa.array(errors, pa.string())], names=[*some.schema.names, "raw", "error"])

    return rows.mapInArrow(read, schema)
