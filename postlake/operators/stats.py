"""The nine statistics reports over a listing, one DataFrame each, with numbers (the text report formats them)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import address_in, extension, first_of
from .filters import is_mail, item_kind

# The order of kinds in the overview.
KINDS = ["e-mail", "contact", "appointment / meeting", "task", "note", "journal", "distribution list", "other"]


def _n(c: Column) -> Column:
    return c.cast("long")


def _size() -> Column:
    return _n(F.coalesce(F.sum("size"), F.lit(0))).alias("size")


def sender_address(columns: list[str]) -> Column:
    """The stored address if it has an @, else the first one in the sender's name."""
    found = address_in(F.col("sender"))
    if "sender_email" in columns:
        return F.when(F.contains("sender_email", F.lit("@")), F.lower(F.trim("sender_email"))).otherwise(found)
    return found


def overview(listing: DataFrame) -> DataFrame:
    kind = item_kind(F.col("message_class"))
    return listing.agg(
        F.count("*").alias("messages"), F.count_distinct("source_name").alias("sources"), F.count_distinct("source_name", "folder").alias("folders"),
        F.min("date").alias("earliest"), F.max("date").alias("latest"), F.count_if(F.col("date").isNull()).alias("undated"), _size(),
        (F.coalesce(F.sum("size"), F.lit(0)) / F.nullif(F.count("*"), F.lit(0))).alias("average_size"),
        F.count_if("is_read").alias("read"), F.count_if(~F.col("is_read")).alias("unread"), F.count_if("has_attachments").alias("with_attachments"),
        *[F.count_if(kind == k).alias("kind_" + k.split(" ")[0].replace("-", "")) for k in KINDS],
    )


def years(listing: DataFrame) -> DataFrame:
    """By year; undated rows, if any, under a null year."""
    return listing.groupBy(_n(F.year("date")).alias("year")).agg(F.count("*").alias("messages"), _size())


def months(listing: DataFrame) -> DataFrame:
    return listing.where("date is not null").groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.count("*").alias("messages"), _size())


def senders(listing: DataFrame, top: int = 20) -> DataFrame:
    name = first_of(F.trim("sender"), F.lit("(no sender)"))
    found = listing.where(is_mail(F.col("message_class"))).groupBy(name.alias("sender")).agg(F.count("*").alias("messages"), _size())
    return found.orderBy(F.desc("messages"), "sender").limit(top)


def domains(listing: DataFrame, top: int = 20) -> DataFrame:
    rows = listing.where(is_mail(F.col("message_class"))).withColumn("address", sender_address(listing.columns)).where("address != ''")
    found = rows.groupBy(F.substring_index("address", "@", -1).alias("domain")).agg(F.count("*").alias("messages"), _size())
    return found.orderBy(F.desc("messages"), "domain").limit(top)


def folders(listing: DataFrame) -> DataFrame:
    return listing.groupBy("source_name", "folder").agg(F.count("*").alias("messages"), _size(), F.count_if(~F.col("is_read")).alias("unread"))


def attachment_totals(listing: DataFrame, attachments: DataFrame) -> DataFrame:
    with_any = listing.agg(F.count_if("has_attachments").alias("messages_with"))
    counted = attachments.where(~F.col("is_inline")).join(listing.where("has_attachments").select("nid"), "nid", "left_semi")
    return with_any.join(counted.agg(F.count("*").alias("attachments"), _size()))  # one row each


def attachment_types(listing: DataFrame, attachments: DataFrame, top: int = 8) -> DataFrame:
    counted = attachments.where(~F.col("is_inline")).join(listing.where("has_attachments").select("nid"), "nid", "left_semi")
    found = counted.groupBy(first_of(extension(F.col("filename")), F.lit("(none)")).alias("ext")).agg(F.count("*").alias("n"))
    return found.orderBy(F.desc("n"), "ext").limit(top)


def largest(listing: DataFrame, top: int = 20) -> DataFrame:
    """The largest messages; of equal sizes the one listed first."""
    subject = first_of(F.col("subject"), F.lit("(no subject)"))
    return listing.orderBy(F.desc(F.coalesce("size", F.lit(0))), "nid").limit(top).select("nid", "date", F.coalesce("sender", F.lit("")).alias("sender"), subject.alias("subject"), "folder", "size")


def classes(listing: DataFrame) -> DataFrame:
    return listing.groupBy(first_of(F.col("message_class"), F.lit("IPM.Note")).alias("message_class")).agg(F.count("*").alias("items"))


def kinds(listing: DataFrame) -> DataFrame:
    return listing.groupBy(item_kind(F.col("message_class")).alias("kind")).agg(F.count("*").alias("items"), _size())


def folder_rollup(listing: DataFrame) -> DataFrame:
    """Messages in each folder and all below it: a row goes to every prefix of its path."""
    parts = F.split("folder", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    own = listing.groupBy("source_name", "folder").agg(F.count("*").alias("n"))
    return own.select("source_name", F.explode(prefixes).alias("folder"), "n").groupBy("source_name", "folder").agg(_n(F.sum("n")).alias("total"))


def compute(listing: DataFrame, attachments: DataFrame | None = None, top: int = 20) -> dict[str, DataFrame]:
    """All reports. The listing is read once for each; cache it if it is costly to make."""
    found = {"overview": overview(listing), "years": years(listing), "months": months(listing), "senders": senders(listing, top), "domains": domains(listing, top), "folders": folders(listing)}
    if attachments is not None:
        found |= {"attachments": attachment_types(listing, attachments)}
    return found | {"largest": largest(listing, top), "classes": classes(listing)}


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def index_totals(messages: DataFrame, attachments: DataFrame) -> DataFrame:
    """Sources, messages, attachments and their bytes, and messages with attachments, of an index."""
    m = messages.agg(F.count_distinct("source_name").alias("sources"), F.count("*").alias("messages"), _n(F.coalesce(F.sum("size"), F.lit(0))).alias("bytes"))
    a = attachments.agg(F.count("*").alias("attachments"), F.count_distinct("nid").alias("with_attachments"))
    return m.join(a)  # one row each


def fingerprints(messages: DataFrame) -> DataFrame:
    """What tells whether a source has changed: its messages, bytes and latest date."""
    return messages.groupBy("source_name").agg(F.count("*").alias("messages"), _size(), F.max("date").alias("latest"))
