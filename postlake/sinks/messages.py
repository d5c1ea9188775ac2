"""Messages, listings, reports and hits as files.

Content is made by column expressions, and Spark's writers store it; a message file is a row of (path, content)
that an export puts at its place (see `export`).
"""

from __future__ import annotations

import html
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import ordinal
from ..functions.text import first_of, human_size, sanitize


def base_name(columns: list[str]) -> Column:
    """`2024-03-05 093015 subject`, as a safe file name."""
    stamp = F.coalesce(F.date_format("date", "yyyy-MM-dd HHmmss"), F.lit("undated"))
    return sanitize(F.concat(stamp, F.lit(" "), first_of(F.col("subject"), F.lit("(no subject)"))), 140)


def output_paths(rows: DataFrame, ext: str, order: str = "nid", per_source: bool = False) -> DataFrame:
    """`path` of each message under its folder (per_source: in one of its source's); later ones of the same name (whatever its case) get (2), (3) ..."""
    folder = F.array_join(F.transform(F.split("folder", "/"), lambda p: sanitize(p)), "/")
    folder = F.concat(sanitize(F.col("source_name")), F.lit("/"), folder) if per_source else folder
    named = rows.withColumn("_base", F.concat(folder, F.lit("/"), base_name(rows.columns)))
    named = ordinal(named.withColumn("_low", F.lower("_base")), ["_low"], order, "_n").withColumn("_n", F.col("_n") + 1)
    number = F.when(F.col("_n") > 1, F.concat(F.lit(" ("), F.col("_n").cast("string"), F.lit(")"))).otherwise("")
    return named.withColumn("path", F.concat("_base", number, F.lit("." + ext))).drop("_base", "_low", "_n")


def header_block(columns: list[str]) -> Column:
    lines = [(label, c) for label, c in (("From", "sender"), ("To", "to"), ("Date", "date"), ("Subject", "subject")) if c in columns]
    return F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), F.nullif(F.col(c).cast("string"), F.lit(""))) for label, c in lines])


def as_text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("content", F.concat(header_block(rows.columns), F.lit("\n\n"), F.coalesce("body", F.lit(""))))


def _html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _base64(data: Column, width: int = 0) -> Column:
    text = F.regexp_replace(F.base64(data), r"\s", "")
    return F.regexp_replace(text, "(.{%d})" % width, "$1\r\n") if width else text


def inlined(html: Column, attachments: Column) -> Column:
    """HTML whose pictures by content id are data URIs."""
    pictures = F.filter(attachments, lambda a: (a["cid"] != "") & a["data"].isNotNull())
    return F.aggregate(pictures, html, lambda page, a: F.replace(page, F.concat(F.lit("cid:"), a["cid"]), F.concat(F.lit("data:"), a["mime"], F.lit(";base64,"), _base64(a["data"]))))


def _inside(html: Column) -> Column:
    """What stands in the body of a document, behind its style sheets; other markup as it is."""
    body = F.regexp_extract(html, r"(?is)<body[^>]*>(.*)</body\s*>", 1)
    styles = F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<style[^>]*>.*?</style\s*>"), F.lit(0)), "")
    return F.when(body != "", F.concat(styles, body)).otherwise(F.regexp_replace(html, r"(?i)</?(?:html|head|body)(?:\s[^>]*)?>", ""))


def as_html(rows: DataFrame) -> DataFrame:
    """A page of its own for each message: its header lines, its attachments by name and size, and its HTML with pictures in it, or else its text."""
    shown = F.concat(F.lit("<pre>"), _html(F.coalesce("body", F.lit(""))), F.lit("</pre>"))
    names = F.lit("")
    if "attachments" in rows.columns:
        seen = F.filter(F.coalesce("attachments", F.array().cast(rows.schema["attachments"].dataType)), lambda a: ~F.coalesce(a["hidden"], F.lit(False)))
        each = F.transform(seen, lambda a: F.concat(F.lit("<li>"), _html(F.coalesce(a["filename"], F.lit(""))), F.lit(" ("), human_size(a["size"]), F.lit(")</li>")))
        names = F.when(F.size(each) > 0, F.concat(F.lit("<ul>"), F.array_join(each, ""), F.lit("</ul>"))).otherwise("")
    if "html" in rows.columns:
        page = inlined(F.col("html"), F.col("attachments")) if "attachments" in rows.columns else F.col("html")
        shown = F.when(F.trim(F.coalesce("html", F.lit(""))) != "", _inside(F.coalesce(page, F.col("html")))).otherwise(shown)
    head = F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><title>'), _html(F.coalesce("subject", F.lit(""))), F.lit("</title></head><body><pre>"), _html(header_block(rows.columns)), F.lit("</pre>"))
    return rows.withColumn("content", F.concat(head, names, F.lit("<hr>"), shown, F.lit("</body></html>")))


def _bytes(*parts: Column | str) -> Column:
    return F.concat(*[F.encode(F.lit(p), "utf-8") if isinstance(p, str) else p for p in parts])


def _attached(a: Column, boundary: Column) -> Column:
    """One attachment as a part: an embedded message as it is, anything else in base64."""
    name = F.replace(F.url_encode(F.coalesce(a["filename"], F.lit(""))), F.lit("+"), F.lit("%20"))
    inline = F.coalesce(a["is_inline"] | a["hidden"], F.lit(False))
    kind = F.when(a["is_embedded"], "message/rfc822").otherwise(F.coalesce(F.nullif(a["mime"], F.lit("")), F.lit("application/octet-stream")))
    lines = F.concat_ws(
        "\r\n", F.concat(F.lit("--"), boundary), F.concat(F.lit("Content-Type: "), kind), F.concat(F.lit("Content-Disposition: "), F.when(inline, "inline").otherwise("attachment"), F.when(name != "", F.concat(F.lit("; filename*=UTF-8''"), name)).otherwise("")),
        F.when(F.coalesce(a["cid"], F.lit("")) != "", F.concat(F.lit("Content-ID: <"), a["cid"], F.lit(">"))), F.concat(F.lit("Content-Transfer-Encoding: "), F.when(a["is_embedded"], "8bit").otherwise("base64")),
    )
    data = F.coalesce(a["data"], F.lit(b""))
    return _bytes(F.encode(lines, "utf-8"), "\r\n\r\n", F.when(a["is_embedded"], data).otherwise(F.encode(_base64(data, 76), "utf-8")), "\r\n")


def as_eml(rows: DataFrame) -> DataFrame:
    """The stored bytes where there are some, else a message made of the listing's fields, its text and HTML, and its attachments."""
    word = lambda c: F.when(F.coalesce(F.col(c), F.lit("")).rlike("^[\\x20-\\x7e]*$"), F.col(c)).otherwise(F.concat(F.lit("=?utf-8?B?"), F.base64(F.encode(F.col(c), "utf-8")), F.lit("?=")))
    lines = [F.concat(F.lit(f"{label}: "), word(c)) for label, c in (("From", "sender"), ("To", "to"), ("Subject", "subject")) if c in rows.columns]
    for label, c in (("Message-ID", "message_id"), ("In-Reply-To", "in_reply_to"), ("References", "refs")):
        if c in rows.columns:
            lines.append(F.when(F.coalesce(F.col(c), F.lit("")).rlike("^[\\x20-\\x7e]+$"), F.concat(F.lit(f"{label}: "), F.col(c))))
    date = F.concat(F.lit("Date: "), F.date_format("date", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    head = F.encode(F.concat(F.concat_ws("\r\n", *lines, date, F.lit("MIME-Version: 1.0")), F.lit("\r\n")), "utf-8")

    def text(kind: str, c: Column) -> Column:
        return _bytes(f"Content-Type: text/{kind}; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n", F.encode(_base64(F.encode(F.coalesce(c, F.lit("")), "utf-8"), 76), "utf-8"), "\r\n")

    plain = text("plain", F.col("body"))
    mark = F.concat(F.lit("=_"), F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ("source_name", "nid", "subject", "date") if c in rows.columns], F.length(F.coalesce("body", F.lit(""))).cast("string"))))
    content = plain
    if "html" in rows.columns:
        inner = F.encode(F.concat(mark, F.lit("a")), "utf-8")
        both = _bytes("Content-Type: multipart/alternative; boundary=\"", inner, "\"\r\n\r\n--", inner, "\r\n", plain, "--", inner, "\r\n", text("html", F.col("html")), "--", inner, "--\r\n")
        content = F.when(F.trim(F.coalesce("html", F.lit(""))) != "", both).otherwise(plain)
    if "attachments" in rows.columns and rows.schema["attachments"].dataType.typeName() == "array":
        outer = F.encode(mark, "utf-8")
        first = _bytes("Content-Type: multipart/mixed; boundary=\"", outer, "\"\r\n\r\n--", outer, "\r\n", content)
        whole = _bytes(F.aggregate("attachments", first, lambda made, a: F.concat(made, _attached(a, mark))), "--", outer, "--\r\n")
        content = F.when(F.size("attachments") > 0, whole).otherwise(content)
    made = F.concat(head, content)
    return rows.withColumn("content", F.coalesce("raw", made) if "raw" in rows.columns else made)


def as_mbox(rows: DataFrame) -> DataFrame:
    """One entry of an mbox: separator and content with quoted From lines; the writer ends it with an empty line.

    Bytes stay what they are: they are taken as characters one by one while lines are quoted, and the string that comes
    out holds them again, whatever their charset.
    """
    text = F.regexp_replace(F.decode(F.col("content").cast("binary"), "ISO-8859-1"), "\r\n", "\n")
    stamp = F.coalesce(F.date_format("date", "EEE MMM dd HH:mm:ss yyyy"), F.lit("Thu Jan 01 00:00:00 1970"))
    entry = F.concat(F.lit("From - "), stamp, F.lit("\n"), F.regexp_replace(text, "(?m)^(>*From )", ">$1"), F.lit("\n"))
    return rows.withColumn("content", F.encode(entry, "ISO-8859-1").cast("string"))


def write_mbox(rows: DataFrame, path: str) -> None:
    """A directory for each folder with its mbox parts, in listing order; a large folder is several ranges of it."""
    out = as_mbox(as_eml(rows)).select("folder", "nid", "content")
    out.repartitionByRange("folder", "nid").sortWithinPartitions("folder", "nid").select("folder", "content").write.partitionBy("folder").text(path)


def write_files(rows: DataFrame, root: str) -> DataFrame:
    """Write (path, content) below the root, each file as a whole or not at all; path, size and error of every row (see `export`)."""
    from .export import export

    return export(rows, root)


def index_rows(rows: DataFrame) -> DataFrame:
    """The export's index: what was exported under which name."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    return rows.select(
        text("source_name").alias("file"), text("folder").alias("folder"), F.coalesce(F.date_format("date", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("date"), text("sender").alias("from"), text("to").alias("to"),
        text("subject").alias("subject"), F.coalesce("size", F.lit(0)).alias("size"), text("att_names").alias("attachments"), text("message_id").alias("message_id"), text("message_class").alias("message_class"), text("path").alias("exported_as"),
    )


def write_index(rows: DataFrame, path: str) -> None:
    out = index_rows(rows)
    out.write.option("header", True).csv(f"{path}/index.csv")
    out.write.json(f"{path}/index.json")


def write_reports(reports: dict[str, DataFrame], path: str) -> None:
    """One CSV a report; each is a few rows or one a folder."""
    for name, df in reports.items():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{name}.csv")


def report_text(report: DataFrame) -> DataFrame:
    """A report's rows as lines of text, sizes in units."""
    cells = [human_size(F.col(c)) if c == "size" else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in report.columns]
    return report.select(F.concat_ws("  ", *cells).alias("line"))


def report_page(reports: dict[str, DataFrame], title: str = "Statistics") -> DataFrame:
    """The lines of one HTML page with a table for each report, in their order; a bar shows a row's share of the most messages."""
    style = "<style>body{font-family:sans-serif}td,th{text-align:left;padding:2px 8px}.n{background:#4a7ebb;height:10px}</style>"
    parts = []
    for i, (name, df) in enumerate(reports.items()):
        cells = [human_size(F.col(c)) if c == "size" else _html(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns]
        row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells])
        counted = next((c for c in ("messages", "n", "count") if c in df.columns), None)
        if counted:
            most = df.agg(F.max(F.col(counted).cast("double")).alias("m")).scalar()
            row = F.concat(row, F.lit('<td><div class="n" style="width:'), F.coalesce(F.round(F.col(counted) * 200 / most, 0), F.lit(0)).cast("int").cast("string"), F.lit('px"></div></td>'))
        head = f"<h2>{html.escape(name)}</h2><table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in df.columns) + "</tr>"
        lines = df.select(F.lit(i).alias("part"), F.monotonically_increasing_id().alias("place"), F.concat(row, F.lit("</tr>")).alias("line"))  # in the report's order
        parts += [lines, _lines(df, [(i, -1, head), (i, 1 << 62, "</table>")])]
    first = f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{html.escape(title)}</title>{style}</head><body><h1>{html.escape(title)}</h1>"
    some = next(iter(reports.values()))
    return reduce(DataFrame.unionByName, [*parts, _lines(some, [(-1, 0, first), (len(reports), 0, "</body></html>")])]).orderBy("part", "place")


def _lines(df: DataFrame, rows: list[tuple[int, int, str]]) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, "part int, place long, line string")


def write_report_page(reports: dict[str, DataFrame], path: str) -> None:
    """The page as one file: reports are a few rows each, or one a folder."""
    report_page(reports).coalesce(1).sortWithinPartitions("part", "place").select("line").write.mode("overwrite").text(path)


def hits_json(hits: DataFrame) -> DataFrame:
    """One JSON object a hit, with the keys of the command line's output."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in hits.columns else F.lit("")
    return hits.select(F.to_json(F.struct(
        text("subject").alias("subject"), text("sender").alias("from"), text("sender_email").alias("from_email"), text("recipients").alias("to"), text("date").alias("date"), text("folder").alias("folder"),
        text("source_name").alias("mailbox"), text("att_names").alias("attachments"), text("matched_in").alias("matched_in"), text("snippet").alias("snippet"), text("size").alias("size"),
    )).alias("json"))
