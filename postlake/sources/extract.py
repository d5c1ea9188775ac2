"""Text of attachments: Office documents, OpenDocument, ZIP archives, RTF, PDF, mail, HTML and plain text.

What an attachment is, and everything about text formats, are column expressions; only formats whose bytes must
be opened go through Python, in Arrow batches. Broken attachments give an empty text; those over MOST bytes, and members of
archives that unpack to more than MEMBER bytes or lie in archives nested deeper than NESTED, aren't opened, which keeps
a task's memory bounded against archives made to burst (a stated limit of extraction, not of messages).
"""

from __future__ import annotations

import email
import html
import io
import re
import zipfile
import zlib
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import extension, html_to_text

MOST, MEMBER, NESTED = 60 << 20, 16 << 20, 3
#: What bytes 128 to 159 are in cp1252, where it has something; the others stay as they are.
WINDOWS = {i: bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(128, 160)}
#: Where the formats keep their text.
OFFICE = {"docx": r"word/document\.xml$", "pptx": r"ppt/slides/slide\d+\.xml$", "xlsx": r"xl/(sharedStrings|worksheets/sheet\d+)\.xml$", "odf": r"content\.xml$"}
# Extensions by format.
FORMATS = {"docx": "docx docm dotx", "xlsx": "xlsx xlsm xltx", "pptx": "pptx pptm potx", "odf": "odt ods odp"}
HTML = "html htm xhtml mht mhtml".split()
PLAIN = "txt md markdown csv tsv json xml log ini cfg conf yaml yml py js ts css sql sh bat ps1 cmd ics vcf vcard tex rst nfo srt c h cpp java cs go rb php pl toml properties diff patch".split()
IMAGES = "png jpg jpeg gif bmp tif tiff webp heic heif svg ico psd raw cr2 nef".split()
#: First bytes (hexadecimal) of old Office files and of ZIP archives.
OLD_OFFICE, PACKED = "D0CF11E0A1B11AE1", "504B"
#: (kind, container whose first bytes are needed, own first bytes, extensions, start of the type); the first that fits counts.
#: An entry of a container without extensions takes what is left of it; outside of one, any of the three signs is enough.
SIGNS = [
    ("msg", OLD_OFFICE, "", ["msg", "oft", ""], ""), ("ole", OLD_OFFICE, "", [], ""), ("pdf", "", "25504446", ["pdf"], "application/pdf"),
    *((kind, PACKED, "", found.split(), "") for kind, found in FORMATS.items()), ("zip", PACKED, "", [], ""),
    ("rtf", "", "7B5C727466", ["rtf"], ""), ("eml", "", "", ["eml", "emlx"], "message/rfc822"), ("html", "", "", HTML, "text/html"),
    ("text", "", "", PLAIN, "text/"), ("image", "", "", IMAGES, "image/"), ("ole", "", "", ["doc", "xls", "ppt"], ""),
]
#: Tables, properties and pictures of RTF; with them every starred destination is left out.
SILENT = {"fonttbl", "colortbl", "stylesheet", "info", "pict"}
RTF = re.compile(rb"\\'([0-9a-fA-F]{2})|\\u(-?\d+) ?|\\([a-zA-Z]+)(-?\d+)? ?|\\(.)|([{}])|([^\\{}\r\n]+)", re.S)


def content_kind(data: Column, name: Column, mime: Column) -> Column:
    """The kind of an attachment by first bytes, name and type, as SIGNS say; `other` where none fits."""
    ext, mime = extension(name), F.coalesce(mime, F.lit(""))
    head = F.hex(F.substring(F.coalesce(data, F.lit(b"")), 1, 8))
    kinds = []
    for kind, container, magic, extensions, start in SIGNS:
        named = ext.isin(extensions) if extensions else F.lit(True)
        signs = [named, *([F.startswith(head, F.lit(magic))] if magic else []), *([F.startswith(mime, F.lit(start))] if start else [])]
        fits = F.startswith(head, F.lit(container)) & named if container else reduce(lambda a, b: a | b, signs)
        kinds.append(F.when(fits, kind))
    return F.coalesce(*kinds, F.lit("other"))


def _xml(data: bytes) -> str:
    s = data.decode("utf-8", "replace")
    s = re.sub(r"</(w:p|a:p|text:p|text:h|si|row)>|<w:br/>|<text:line-break/>", "\n", s)
    s = re.sub(r"</(w:tc|c)>|<w:tab/>", "\t", s)
    return html.unescape(re.sub(r"<[^>]+>", "", s))


def _archive(data: bytes, kind: str, depth: int) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [i.filename for i in z.infolist() if i.file_size <= MEMBER and not i.is_dir()]
        if kind in OFFICE:
            numbers = lambda n: [int(x) for x in re.findall(r"\d+", n)]
            return "\n".join(_xml(z.read(n)) for n in sorted(filter(re.compile(OFFICE[kind]).search, names), key=lambda n: (n.rpartition("/")[0], numbers(n))))
        return "\n".join(f"{n}\n{opened(z.read(n), _named(n), depth + 1)}".strip() for n in names) if depth < NESTED else ""


def _named(name: str) -> str:
    ext = name.rpartition(".")[2].lower()
    return next((k for k, found in FORMATS.items() if ext in found.split()), ext if ext in ("zip", "rtf", "pdf", "eml") else "html" if ext in HTML else "text" if ext in PLAIN else "other")


def rtf_text(data: bytes) -> str:
    """The text of an RTF document; groups of SILENT and starred destinations are left out."""
    page = re.search(rb"\\ansicpg(\d+)", data)
    codec, out, held, silent, width, drop = f"cp{page[1].decode()}" if page else "cp1252", [], [], False, 1, 0
    for m in RTF.finditer(data):
        code, point, word, number, sign, brace, plain = m.groups()
        if brace == b"{":
            held.append((silent, width))
        elif brace:
            silent, width = held.pop() if held else (False, 1)
        elif sign == b"*" or word and word.decode() in SILENT:
            silent = True
        elif word == b"uc":
            width = int(number or 1)
        elif silent:
            continue
        elif word:
            out.append("\n" if word in (b"par", b"line", b"sect", b"page", b"row") else "\t" if word in (b"tab", b"cell") else "")
        elif point:
            out.append(chr(int(point) % 65536))
            drop = width
        elif code and drop:
            drop -= 1
        elif code:
            out.append(bytes([int(code, 16)]).decode(codec, "replace"))
        elif sign:
            out.append({b"~": " ", b"_": "-", b"\n": "\n"}.get(sign, sign.decode("latin-1") if sign in b"\\{}" else ""))
        else:
            out.append(plain[drop:].decode(codec, "replace"))
            drop = 0
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace").strip()


def pdf_text(data: bytes) -> str:
    """Strings that text operators of a PDF show; pages whose fonts have their own codes are left out as unreadable."""
    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)endstream", data, re.S):
        try:
            body = zlib.decompressobj().decompress(m[1])  # a stream that is cut off gives what there is
        except zlib.error:
            body = m[1]
        for block in re.findall(rb"\bBT\b(.*?)\bET\b", body, re.S):
            shown = re.sub(rb"\\([nrtbf()\\]|[0-7]{1,3})", _escape, b"".join(b" " if s[1] else s[0] for s in re.findall(rb"\(((?:\\.|[^\\()])*)\)|(T[d*D]|TJ|Tj|')", block, re.S)))
            out.append(re.sub(r"\s+", " ", shown.decode("cp1252", "replace")).strip())
    text = "\n".join(filter(None, out))
    return text if text and sum(c.isprintable() or c.isspace() for c in text) >= 0.9 * len(text) else ""


def _escape(m: re.Match) -> bytes:
    s = m[1]
    return bytes([int(s, 8) & 255]) if s.isdigit() else {b"n": b"\n", b"r": b"\n", b"t": b"\t", b"b": b"", b"f": b""}.get(s, s)


def mail_text(data: bytes, depth: int) -> str:
    """Headers, bodies and attachments of an attached message."""
    from .mime import decoded, header, header_filename, leaves

    m = email.message_from_bytes(data)
    out = [header(m, h) for h in ("Subject", "From", "To")]
    for part in leaves(m):
        name, body = header_filename(part), part.get_payload(decode=True) or b""
        if name or part.get_content_disposition() == "attachment":
            out.append(f"{name}\n{opened(body, _named(name), depth + 1)}".strip())
        elif part.get_content_maintype() == "text":
            s = decoded(body, part.get_content_charset())
            out.append(html.unescape(re.sub("<[^>]+>", " ", s)) if part.get_content_subtype() == "html" else s)
    return "\n".join(filter(None, out))


def opened(data: bytes, kind: str, depth: int = 0) -> str:
    """The text of one attachment that must be opened; a broken one has none."""
    try:
        if len(data) > MOST:
            return ""
        if kind in (*OFFICE, "zip"):
            return _archive(data, kind, depth)
        if kind == "eml":
            return mail_text(data, depth) if depth < NESTED else ""
        if kind in ("text", "html"):
            s = data.decode("utf-8", "replace")
            return html.unescape(re.sub(r"(?s)<(script|style).*?</\1>|<[^>]+>", " ", s)) if kind == "html" else s
        return {"rtf": rtf_text, "pdf": pdf_text}.get(kind, lambda _: "")(data)
    except Exception:  # whatever a broken file brings about; its name is indexed all the same
        return ""


@F.pandas_udf(StringType())
def _opened(data: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([opened(d, k).replace("\x00", "") if d is not None else "" for d, k in zip(data, kind, strict=True)], dtype=object)


def plain_text(data: Column) -> Column:
    """Bytes as text: by a byte order mark, else as UTF-8 if they are that, else as cp1252."""
    head, latin = F.hex(F.substring(data, 1, 3)), F.decode(data, "ISO-8859-1")
    windows = F.translate(latin, "".join(map(chr, WINDOWS)), "".join(WINDOWS.values()))
    text = (
        F.when(F.startswith(head, F.lit("FFFE")), F.decode(data, "UTF-16LE")).when(F.startswith(head, F.lit("FEFF")), F.decode(data, "UTF-16BE"))
        .when(F.is_valid_utf8(data.cast("string")), data.cast("string")).otherwise(windows)
    )
    return F.replace(text, F.lit("\ufeff"), F.lit(""))


def readable_runs(data: Column, least: int = 6) -> Column:
    """Runs of readable characters in a binary file, of one byte each and then of two (UTF-16LE), one a line."""
    latin = F.decode(data, "ISO-8859-1")
    one = F.regexp_extract_all(latin, F.lit("[\\x20-\\x7e]{%d,}" % least), F.lit(0))
    two = F.transform(F.regexp_extract_all(latin, F.lit("(?:[\\x20-\\x7e]\\x00){%d,}" % least), F.lit(0)), lambda s: F.translate(s, "\x00", ""))
    return F.array_join(F.concat(one, two), "\n")


def attachment_text(data: Column, name: Column, mime: Column | None = None) -> Column:
    """The whole text of one attachment; of old binary Office files the runs of six or more readable characters."""
    kind, small = content_kind(data, name, F.lit("") if mime is None else mime), F.octet_length(data) <= MOST
    return (
        F.when(~small | data.isNull(), "").when(kind.isin(*OFFICE, "zip", "rtf", "pdf", "eml"), _opened(data, kind)).when(kind == "html", html_to_text(plain_text(data)))
        .when(kind == "text", plain_text(data)).when(kind == "ole", readable_runs(data)).otherwise("")
    )


def with_attachment_text(messages: DataFrame, depth: int | None = None, total: int | None = None, always: Iterable[str] = ()) -> DataFrame:
    """Messages whose `attachments` is the text the index holds: a bullet and the name before each text.

    Attached messages are rows of their own (see `embedded`), at any depth unless one is given: their headers, body and
    attachments follow the bullet of their attachment. `att_count` and `att_names` take in what they hold. always: which
    of an attached message's subject, sender, to and body take a line where they are empty as well. Messages are parsed
    once: they are settled as they come, so leave out columns that nobody reads. They may share ids, or have none.
    """
    from . import embedded

    always, tops = set(always), embedded.settled(messages.withColumn("_top", F.monotonically_increasing_id()))
    top = tops.select(F.lit("").alias("source_name"), F.lit("").alias("folder"), F.col("_top").alias("nid"), "attachments")
    inside = embedded.levels(top, depth, total, ["subject", "sender", "to", "body"])
    each = [m.select("nid", "path", F.posexplode("attachments").alias("i", "a")) for m in (top.withColumn("path", F.array().cast("array<int>")), *inside)]
    a, mail = reduce(DataFrame.unionByName, each), embedded.is_mail(F.col("a"))
    # Functions in Python get every row, so messages go without their bytes.
    a = a.select("nid", F.concat("path", F.array("i")).alias("path"), F.col("a.filename").alias("filename"), F.col("a.mime").alias("mime"), F.when(~mail, F.col("a.data")).alias("data"))
    a = a.select("nid", "path", "filename", attachment_text(F.col("data"), F.col("filename"), F.col("mime")).alias("text"))
    rows = a.select("nid", "path", F.when(F.size("path") > 1, F.coalesce("filename", F.lit(""))).alias("name"), F.when(F.col("text") != "", F.concat(F.lit("• "), "filename", F.lit("\n"), "text")).alias("t"))
    shown = lambda c: F.coalesce(F.col(c), F.lit("")) if c in always else F.nullif(F.col(c), F.lit(""))
    text = F.concat_ws("\n", F.concat(F.lit("• "), F.coalesce(shown("subject"), F.lit("message"))), *map(shown, ("subject", "sender", "to", "body")))
    for m in inside:
        rows = rows.unionByName(m.select("nid", "path", F.lit(None).cast("string").alias("name"), text.alias("t")))
    # A group is one message's attachments, in the order of their paths.
    found = rows.groupBy(F.col("nid").alias("_top")).agg(F.array_sort(F.collect_list(F.struct("path", "name", "t"))).alias("_all"), F.count("name").alias("_more"))
    joined = lambda c, by: F.array_join(F.filter(F.transform("_all", lambda p: p[c]), lambda x: x.isNotNull()), by)
    found = found.select("_top", "_more", joined("t", "\n").alias("_text"), joined("name", " ").alias("_names"))
    out = tops.drop("attachments").join(found, "_top", "left").withColumn("attachments", F.coalesce("_text", F.lit("")))
    if inside:
        out = out.withColumns({"att_count": F.col("att_count") + F.coalesce("_more", F.lit(0)), "att_names": F.trim(F.concat_ws(" ", "att_names", "_names"))})
    return out.drop("_top", "_more", "_text", "_names")
