"""Messages inside messages, as rows: one level a step, whatever their depth.

A step parses the messages of one level in Arrow batches and hands on what they hold as rows of their own: their parts
at `path`, the numbers of the attachments that lead to them from the message on top. A message that holds very many is
dealt out as rows are; no task recurses, and a step's rows are settled in shared storage, so that a level isn't parsed
anew for the next.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import shared_path
from ..functions.text import extension
from . import mime

#: Columns that name a message: its source, its number there, and where in the message on top it stands.
KEY = ["source_name", "nid", "path"]


def settled(df: DataFrame) -> DataFrame:
    """The rows as written to shared storage, so that nobody computes them again."""
    at = shared_path(df.sparkSession, "embedded")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def is_mail(a: Column) -> Column:
    """Whether an attachment is a message: by its type, or a message file by its name."""
    return F.coalesce(a["is_embedded"], F.lit(False)) | extension(a["filename"]).isin("eml", "emlx")


def children(messages: DataFrame) -> DataFrame:
    """The messages attached to messages (which have path), in the shape that `mime.messages` takes, with path."""
    a = messages.select("source_name", "folder", "nid", "path", F.posexplode("attachments").alias("i", "a")).where(is_mail(F.col("a")) & F.col("a.data").isNotNull())
    kind = F.when(extension(F.col("a.filename")) == "emlx", "emlx").otherwise("eml")
    return a.select("source_name", "folder", "nid", F.concat("path", F.array("i")).alias("path"), kind.alias("kind"), F.col("a.data").alias("raw"), F.lit(None).cast("boolean").alias("flag_read"))


def levels(messages: DataFrame, depth: int | None = None, total: int | None = None, columns: list[str] | None = None) -> list[DataFrame]:
    """The messages attached to `messages` (source_name, folder, nid, attachments), a table for each level that has any.

    depth: so many levels at most (the reference's index: 3); null, which all queries use, follows every one.
    total: bytes of embedded messages of one message on top at most, the levels above first and in order; null: all.
    columns: what of a message is settled besides its key and its attachments, which hold the bytes of the next level; null: all.
    """
    found: list[DataFrame] = []
    spent: DataFrame | None = None
    level = messages.withColumn("path", F.array().cast("array<int>"))
    while depth is None or len(found) < depth:
        raw = children(level)
        if total is not None:
            raw, spent = _within(raw, spent, total)
        # Levels travel with their key through the parser under the columns that it keeps.
        keyed = raw.withColumns({"folder": F.to_json(F.struct("folder", "path"))})
        parsed = mime.messages(keyed, whole=columns is None).withColumn("_k", F.from_json("folder", "folder string, path array<int>"))
        parsed = parsed.withColumns({"folder": F.col("_k.folder"), "path": F.col("_k.path")}).drop("_k")
        level = settled(parsed if columns is None else parsed.select("source_name", "folder", "nid", "path", "attachments", *columns))
        if not level.select("path").take(1):
            break
        found.append(level)
    return found


def _within(raw: DataFrame, spent: DataFrame | None, total: int) -> tuple[DataFrame, DataFrame]:
    """The messages of a level that fit into what is left of their message's total, and what is spent with them."""
    from pyspark.sql import Window

    raw = raw.withColumn("_size", F.octet_length("raw").cast("long"))
    before = raw if spent is None else raw.join(spent, ["source_name", "nid"], "left")
    used = F.lit(0).cast("long") if spent is None else F.coalesce("_spent", F.lit(0))
    # A group is one message's attachments.
    running = F.sum("_size").over(Window.partitionBy("source_name", "nid").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)) + used
    kept = settled(before.withColumn("_end", running).where(F.col("_end") <= total))
    sums = kept.groupBy("source_name", "nid").agg(F.max("_end").alias("_now"))
    spent = sums.select("source_name", "nid", F.col("_now").alias("_spent")) if spent is None else spent.join(sums, ["source_name", "nid"], "full").select("source_name", "nid", F.coalesce("_now", "_spent").alias("_spent"))
    return kept.drop("_size", "_end", *(["_spent"] if "_spent" in kept.columns else [])), settled(spent)


def unnested(messages: DataFrame, depth: int | None = None, total: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """All messages attached at any depth, with `path` and `depth` (1 for those attached to `messages` themselves)."""
    found = levels(messages, depth, total, columns)
    if not found:
        empty = messages.withColumns({"path": F.array().cast("array<int>"), "depth": F.lit(0)})
        return empty.limit(0)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found).withColumn("depth", F.size("path"))


def totals(messages: DataFrame, depth: int | None = None) -> DataFrame:
    """(source_name, nid, attachments, embedded, size) of each message with all that its embedded ones hold."""

    def own(rows: DataFrame, inside: int) -> DataFrame:
        size = F.aggregate(F.coalesce("attachments", F.array().cast(rows.schema["attachments"].dataType)), F.lit(0).cast("long"), lambda s, a: s + F.when(is_mail(a), 0).otherwise(F.coalesce(a["size"], F.lit(0))))
        return rows.select("source_name", "nid", F.greatest(F.size("attachments"), F.lit(0)).alias("attachments"), F.lit(inside).alias("embedded"), size.alias("size"))

    parts = [own(messages, 0), *[own(level, 1) for level in levels(messages, depth, columns=[])]]
    return reduce(DataFrame.unionByName, parts).groupBy("source_name", "nid").agg(*[F.sum(c).alias(c) for c in ("attachments", "embedded", "size")])
