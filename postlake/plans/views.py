"""The driver's tables in the mail shape, as DataFrames and as the SQL of the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def listing(spark: SparkSession, d: str, attachments: bool = False) -> DataFrame:
    """Orders as listing rows. has_attachments costs a pass over lineitem and is only added on request."""
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    mc = F.when(F.col("c_mktsegment") == "BUILDING", "IPM.Contact").when(F.col("c_mktsegment") == "FURNITURE", "IPM.Appointment")
    mc = mc.when(F.col("c_mktsegment") == "MACHINERY", "REPORT.IPM.Note.NDR").when(F.col("c_mktsegment") == "AUTOMOBILE", "").otherwise("IPM.Note")
    rows = rows.select(
        F.col("o_orderkey").alias("nid"), F.col("r_name").alias("source_name"), F.concat("r_name", F.lit("/"), "n_name").alias("folder"),
        F.concat("o_orderpriority", F.lit(" order "), F.col("o_orderkey").cast("string")).alias("subject"), F.col("c_name").alias("sender"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@"), F.lower(F.replace("n_name", F.lit("_"), F.lit("-"))), F.lit(".example.com")).alias("sender_email"),
        F.col("o_orderdate").alias("date"), F.floor("o_totalprice").cast("long").alias("size"), (F.col("o_orderstatus") != "O").alias("is_read"), mc.alias("message_class"),
    )
    if attachments:
        having = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("nid")).distinct().withColumn("_a", F.lit(True))
        rows = rows.join(having, "nid", "left").withColumn("has_attachments", F.coalesce("_a", F.lit(False))).drop("_a")
    return rows


def attachments(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    ext = F.when(F.col("p_type") == "ECONOMY", ".pdf").when(F.col("p_type") == "LARGE", ".docx").when(F.col("p_type") == "MEDIUM", ".png")
    ext = ext.when(F.col("p_type") == "PROMO", ".zip").when(F.col("p_type") == "SMALL", ".exe").otherwise("")
    rows = table(spark, d, "lineitem").join(p, F.col("l_partkey") == p.p_partkey)
    return rows.select(F.col("l_orderkey").alias("nid"), F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), ext).alias("filename"), (F.col("l_returnflag") == "R").alias("is_inline"), F.floor("l_extendedprice").cast("long").alias("size"))


def _address() -> Column:
    """The first mail address of the text. It begins where a run of its characters does, so no other place is tried."""
    found = F.regexp_extract("text", "(?<![A-Za-z0-9_.+-])([A-Za-z0-9_.+-]++@[A-Za-z0-9_-]+([.][A-Za-z0-9_-]+)+)", 1)
    return F.when(~F.contains("text", F.lit("@")), "").otherwise(found)


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("source_name"), F.col("lang").alias("folder"), F.substring_index("text", "\n", 1).alias("subject"),
        F.col("text").alias("body"), _address().alias("sender"), F.col("n_chars").alias("size"),
    )


LISTING = """listing AS (
SELECT o.o_orderkey AS nid, r.r_name AS source_name, concat(r.r_name, '/', n.n_name) AS folder,
       concat(o.o_orderpriority, ' order ', o.o_orderkey) AS subject, c.c_name AS sender,
       concat(lower(replace(c.c_name, '#', '.')), '@', lower(replace(n.n_name, '_', '-')), '.example.com') AS sender_email,
       o.o_orderdate AS date, CAST(floor(o.o_totalprice) AS BIGINT) AS size, o.o_orderstatus <> 'O' AS is_read,
       CASE c.c_mktsegment WHEN 'BUILDING' THEN 'IPM.Contact' WHEN 'FURNITURE' THEN 'IPM.Appointment'
            WHEN 'MACHINERY' THEN 'REPORT.IPM.Note.NDR' WHEN 'AUTOMOBILE' THEN '' ELSE 'IPM.Note' END AS message_class,
       la.l_orderkey IS NOT NULL AS has_attachments
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
     JOIN region r ON n.n_regionkey = r.r_regionkey
     LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) la ON la.l_orderkey = o.o_orderkey)"""
ATTACHMENTS = """attachments AS (
SELECT l.l_orderkey AS nid,
       concat(replace(p.p_name, ' ', '_'), CASE p.p_type WHEN 'ECONOMY' THEN '.pdf' WHEN 'LARGE' THEN '.docx'
              WHEN 'MEDIUM' THEN '.png' WHEN 'PROMO' THEN '.zip' WHEN 'SMALL' THEN '.exe' ELSE '' END) AS filename,
       l.l_returnflag = 'R' AS is_inline, CAST(floor(l.l_extendedprice) AS BIGINT) AS size
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""
DOCS = """docs AS (
SELECT doc_id AS id, source AS source_name, lang AS folder, split_part(text, chr(10), 1) AS subject, text AS body,
       regexp_extract(text, '([A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+([.][A-Za-z0-9_-]+)+)', 1) AS sender, n_chars AS size FROM documents)"""
#: Tokens of the three filled columns, and their normalised text.
NORMS = DOCS + r""", norms AS (
SELECT *, ' ' || trim(regexp_replace(strip_accents(lower(subject)), '[^\p{L}\p{N}\p{Co}]+', ' ', 'g')) || ' ' AS ns,
       ' ' || trim(regexp_replace(strip_accents(lower(sender)), '[^\p{L}\p{N}\p{Co}]+', ' ', 'g')) || ' ' AS ne,
       ' ' || trim(regexp_replace(strip_accents(lower(body)), '[^\p{L}\p{N}\p{Co}]+', ' ', 'g')) || ' ' AS nb FROM docs)"""
