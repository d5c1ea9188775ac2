"""Message bytes to rows: Arrow batches of raw messages in, listing fields, bodies and attachments out.

A message that can't be parsed is a row with its reason in `error`; it never fails the job.
"""

from __future__ import annotations

import datetime as dt
import io
import re
from collections.abc import Callable, Iterator
from email.feedparser import BufferedSubFile, FeedParser
from email.generator import BytesGenerator
from email.header import decode_header, make_header
from email.message import Message
from email.policy import Compat32
from email.utils import getaddresses, parsedate_to_datetime

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import body_text, first_of, html_to_text

RECIPIENT = "struct<kind:string,name:string,email:string>"
ATTACHMENT = "struct<filename:string,mime:string,cid:string,hidden:boolean,is_inline:boolean,is_embedded:boolean,size:bigint,data:binary>"
PARSED = (
    "subject string, sender_name string, sender_email string, recipients array<" + RECIPIENT + ">, date timestamp, message_id string, in_reply_to string, refs string, "
    "status string, mozilla_status string, priority string, content_type string, plain string, html string, attachments array<" + ATTACHMENT + ">, error string"
)
#: Charset names that Python doesn't know.
CHARSETS = {"unicode-1-1-utf-7": "utf-7", "x-unknown": "utf-8", "unknown-8bit": "utf-8", "ansi_x3.110-1983": "latin-1", "cp-850": "cp850"}


#: Where a message's date may stand, the first one first.
DATES = ("Date", "Delivery-Date", "X-Original-Date", "Resent-Date", "Received")


def decoded(data: bytes, charset: str | None = None) -> str:
    for name in (CHARSETS.get((charset or "").lower(), charset), "utf-8", "cp1252"):
        try:
            return data.decode(name or "utf-8")
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("latin-1")


def header(message, name: str) -> str:
    """Unfolded, with encoded words decoded; raw 8-bit bytes as UTF-8 or else cp1252."""
    value = message.get(name)
    if value is None:
        return ""
    raw = str(value)
    if re.search("[\udc80-\udcff]", raw):
        raw = decoded(raw.encode("utf-8", "surrogateescape"))
    if "=?" in raw:  # what begins an encoded word
        try:
            raw = str(make_header(decode_header(raw)))
        except (LookupError, UnicodeDecodeError, ValueError):
            pass
    return re.sub(r"\s*[\r\n]+\s*", " ", raw).strip()


def when(message, *names: str) -> dt.datetime | None:
    """The first of these headers that holds a date, in UTC; Received ends with one after a semicolon."""
    for name in names:
        value = (message.get(name) or "").rpartition(";")[2].strip()
        if not value:
            continue
        try:
            found = parsedate_to_datetime(value)
            return found.replace(tzinfo=dt.UTC) if found.tzinfo is None else found.astimezone(dt.UTC)
        except (ValueError, TypeError, OverflowError):
            continue
    return None


class Plain(Compat32):
    """Writes headers as the standard policy does; one that folding leaves as it is isn't taken apart."""

    AS_IT_IS = re.compile(r"[!-~]+(?: [!-~]+)*").fullmatch

    def fold_binary(self, name: str, value: str) -> bytes:
        if isinstance(value, str) and len(name) + 2 + len(value) < 76 and self.AS_IT_IS(value) and name.isascii():
            return f"{name}: {value}{self.linesep}".encode()
        return super().fold_binary(name, value)


class Writer(BytesGenerator):
    """Writes the lines of a body at once."""

    def _write_lines(self, lines: str) -> None:
        if lines:
            self.write(re.sub("\r\n|\r|\n", self._NL, lines))


def written(message: Message) -> bytes:
    """The bytes that the standard library's `as_bytes` gives."""
    out = io.BytesIO()
    Writer(out, mangle_from_=False, policy=Plain()).flatten(message)
    return out.getvalue()


class Part(Message):
    """A message that finds out its content type once; the parser and the writer ask for it many times."""

    _kind: str | None = None

    def set_raw(self, name: str, value: str) -> None:
        self._kind = None
        super().set_raw(name, value)

    def set_default_type(self, ctype: str) -> None:
        self._kind = None
        super().set_default_type(ctype)

    def get_content_type(self) -> str:
        if self._kind is None:
            self._kind = super().get_content_type()
        return self._kind


class Outer(Part):
    """A message whose attached messages stay lines as they stand; each is parsed when its turn comes."""

    def get_content_maintype(self) -> str:
        kind = self.get_content_type()
        return "application" if kind == "message/rfc822" else kind.partition("/")[0]


class Lines(BufferedSubFile):
    """The parser's lines. Only a boundary or an empty line can end a part, so others are tested against none."""

    def readline(self):
        if self._lines and self._lines[0][:1] not in "-\r\n":
            return self._lines.popleft()
        return super().readline()

    def __next__(self):
        if self._lines and self._lines[0][:1] not in "-\r\n":
            return self._lines.popleft()
        return super().__next__()


def read(raw: bytes, kind: type[Message] = Part, head: bool = False) -> Message:
    """The message that the standard library's parser gives; of kind Outer only to the first level of attached messages.

    head: only its headers are taken apart.
    """
    parser = FeedParser(kind)
    parser._input = Lines()
    if head:
        parser._set_headersonly()
    parser.feed(raw.decode("ascii", "surrogateescape"))
    return parser.close()


def attached_subject(data: bytes) -> str:
    """The subject of an attached message, from its header block alone."""
    block = header_block_of(data)
    return header(read(block, head=True), "Subject") if b"subject" in block.lower() else ""


def parse(raw: bytes) -> dict:
    """The fields of a message. Those attached to it are bytes as they stand there, and their parts aren't looked at."""
    m = read(raw, Outer)
    named = {k.lower() for k in m.keys()}
    # Most of these headers are missing in most messages.
    field = lambda name: header(m, name) if name.lower() in named else ""
    people = [(kind, name, addr) for kind in ("To", "Cc", "Bcc") if (value := field(kind)) for name, addr in getaddresses([value]) if name or addr]
    sender = field("From") or field("Sender")
    name, addr = (getaddresses([sender]) or [("", "")])[0] if sender else ("", "")
    plain, html, atts = [], [], []
    for part in leaves(m):
        kind, filename = part.get_content_type(), header_filename(part)
        embedded = kind == "message/rfc822"
        if kind in ("text/plain", "text/html") and not filename and part.get_content_disposition() != "attachment":
            (plain if kind == "text/plain" else html).append(decoded(part.get_payload(decode=True) or b"", part.get_content_charset()))
            continue
        data = part._payload.encode("ascii", "surrogateescape") if embedded else part.get_payload(decode=True) or b""
        cid = (part.get("Content-ID") or "").strip(" <>")
        atts.append({"filename": filename or (f"{attached_subject(data) or 'message'}.eml" if embedded else ""), "mime": kind, "cid": cid, "is_inline": part.get_content_disposition() == "inline", "is_embedded": embedded, "size": len(data), "data": data})
    page = "\n".join(html)
    for a in atts:
        a["hidden"] = bool(a["cid"]) and f"cid:{a['cid']}" in page
    return {
        "subject": field("Subject"), "sender_name": name, "sender_email": addr, "recipients": [dict(zip(("kind", "name", "email"), p, strict=True)) for p in people],
        "date": when(m, *(n for n in DATES if n.lower() in named)), "message_id": field("Message-ID"), "in_reply_to": field("In-Reply-To"),
        "refs": field("References"), "status": field("Status"), "mozilla_status": field("X-Mozilla-Status"), "priority": field("Importance") or field("X-Priority"),
        "content_type": field("Content-Type"), "plain": "\n\n".join(plain), "html": page, "attachments": atts, "error": None,
    }


def leaves(part):
    if part.get_content_maintype() == "multipart" and part.is_multipart():
        for p in part.get_payload():
            yield from leaves(p)
    else:
        yield part


def header_filename(part) -> str:
    if "content-disposition" not in part and "name" not in str(part.get("content-type", "")).lower():
        return ""
    try:
        return re.sub(r"[\r\n]+", "", str(make_header(decode_header(part.get_filename() or ""))))
    except (LookupError, UnicodeDecodeError, ValueError):
        return part.get_filename() or ""


def emlx_payload(data: bytes) -> bytes:
    """An .emlx file begins with the byte count of its message on a line; a property list follows the message."""
    line, _, rest = data.partition(b"\n")
    return rest[: int(line)] if line.strip().isdigit() else data


def _read_flag() -> Column:
    """Maildir flag, else Status, else the Mozilla bit, else read."""
    moz = F.conv(F.col("mozilla_status"), 16, 10).cast("long")
    return F.coalesce(F.col("flag_read"), F.when(F.col("status") != "", F.contains("status", F.lit("R"))), F.when(F.col("mozilla_status") != "", moz.bitwiseAND(1) != 0), F.lit(True))


#: Bytes of messages that a worker has parsed at a time, about; a larger one is parsed by itself.
PORTION = 4 << 20


def portions(raw: pa.Array) -> Iterator[tuple[int, int]]:
    """Where portions of a batch of messages begin and end."""
    lo, held = 0, 0
    for i, n in enumerate(pc.binary_length(raw).to_pylist()):
        if i > lo and held + (n or 0) > PORTION:
            yield lo, i
            lo, held = i, 0
        held += n or 0
    if lo < len(raw):
        yield lo, len(raw)


def _parsed(raw: DataFrame, part: Callable[[bytes], bytes] = lambda data: data, whole: bool = True) -> DataFrame:
    """Raw messages with the fields of PARSED; part: what of a message is parsed; whole: the raw bytes are kept."""
    keep = ["source_name", "folder", "nid", "kind", "raw", "flag_read"]
    raw = raw.withColumns({c: F.lit(None).cast(t) for c, t in (("size", "long"), ("error", "string")) if c not in raw.columns})
    raw = raw.select(*keep, F.coalesce("size", F.octet_length("raw").cast("long")).alias("_size"), F.col("error").alias("_error"))
    columns = [c for c in raw.columns if whole or c != "raw"]
    schema = ", ".join(f"{c} {raw.schema[c].dataType.simpleString()}" for c in columns) + ", " + PARSED
    parsed = to_arrow_schema(StructType.fromDDL(PARSED))
    empty = dict.fromkeys(parsed.names)

    def of(batch):
        rows = []
        for kind, data, error in zip(batch["kind"].to_pylist(), batch["raw"].to_pylist(), batch["_error"].to_pylist(), strict=True):
            try:
                rows.append(empty | {"subject": f"(unreadable: {error})", "error": error} if error or data is None else parse(part(emlx_payload(data) if kind == "emlx" else data)))
            except Exception as e:  # whatever a broken message brings about
                reason = f"{type(e).__name__}: {e}"[:300]
                rows.append(empty | {"subject": f"(unreadable: {reason})", "error": reason})
        arrays = [pa.array([r[f.name] for r in rows], f.type) for f in parsed]
        return pa.RecordBatch.from_arrays([batch[c] for c in columns] + arrays, names=columns + parsed.names)

    def run(batches):
        for batch in batches:
            for lo, hi in portions(batch["raw"]):
                yield of(batch.slice(lo, hi - lo))

    return raw.mapInArrow(run, schema)


def _listed(m: DataFrame) -> dict[str, Column]:
    """The listing's fields of parsed messages."""
    address = F.col("sender_email")
    name = F.when((F.col("sender_name") == "") | (F.lower("sender_name") == F.lower(address)), address).otherwise(F.concat("sender_name", F.lit(" <"), address, F.lit(">")))
    deleted = F.coalesce(F.conv("mozilla_status", 16, 10).cast("long").bitwiseAND(8) != 0, F.lit(False))
    shown = F.transform(F.filter("recipients", lambda r: r["kind"] == "To"), lambda r: first_of(r["name"], r["email"]))
    level = F.lower("priority")
    return {
        "subject": F.concat(F.when(deleted, "(deleted) ").otherwise(""), F.coalesce("subject", F.lit(""))), "sender": F.coalesce(name, F.lit("")), "sender_email": F.coalesce(address, F.lit("")),
        "to": F.coalesce(F.array_join(shown, "; "), F.lit("")), "recipients": recipients_text(), "date": F.col("date"), "size": F.coalesce("_size", F.lit(0).cast("long")), "is_read": _read_flag(),
        "importance": F.when(level.rlike("^(high|1|2)"), 2).when(level.rlike("^(low|4|5)"), 0).otherwise(1), "message_class": F.lit("IPM.Note"),
    }


def messages(raw: DataFrame, whole: bool = True) -> DataFrame:
    """Listing fields, bodies, recipients and attachments of raw messages.

    raw has source_name, folder, nid, kind, raw, flag_read (null if the container doesn't say), and may have size and error.
    whole: with the raw bytes, which needn't travel where nobody reads them.
    """
    m = _parsed(raw, whole=whole)
    return m.select(
        "source_name", "folder", "nid", *[c.alias(k) for k, c in _listed(m).items()],
        F.coalesce(F.exists("attachments", lambda a: ~a["hidden"]), F.lit(False)).alias("has_attachments"), F.coalesce(F.size("attachments"), F.lit(0)).cast("long").alias("att_count"),
        F.coalesce(F.array_join(F.filter(F.transform("attachments", lambda a: a["filename"]), lambda n: n != ""), " "), F.lit("")).alias("att_names"),
        "message_id", "in_reply_to", "refs", body_text(F.when(F.trim("plain") != "", F.col("plain")).otherwise(html_to_text(F.col("html")))).alias("body"), "html", "attachments", *(["raw"] if whole else []), "error",
    )


def header_block_of(data: bytes) -> bytes:
    end = re.search(rb"\r?\n\r?\n", data)
    return data[: end.end()] if end else data


def heads(raw: DataFrame) -> DataFrame:
    """The listing's fields of raw messages from their header blocks alone, which is all that raw need hold (then with size).

    Whether there are attachments is guessed from the content type of the whole.
    """
    m = _parsed(raw, header_block_of)
    kind = F.lower("content_type")
    inside = kind.rlike("multipart/(mixed|related)|application/") | (F.contains(kind, F.lit("name=")) & ~F.contains(kind, F.lit("multipart/alternative")))
    return m.select("source_name", "folder", "nid", *[c.alias(k) for k, c in _listed(m).items()], F.coalesce(inside, F.lit(False)).alias("has_attachments"), "message_id", "in_reply_to", "refs", "error")


def recipients_text() -> Column:
    """`name <address>; ...`, or the one there is."""
    both = lambda r: F.when((r["name"] != "") & (r["email"] != "") & (F.lower(r["name"]) != F.lower(r["email"])), F.concat(r["name"], F.lit(" <"), r["email"], F.lit(">"))).otherwise(first_of(r["name"], r["email"]))
    return F.coalesce(F.array_join(F.transform("recipients", both), "; "), F.lit(""))


def attachments(messages: DataFrame) -> DataFrame:
    """One row an attachment: the child table of messages."""
    rows = messages.select("source_name", "nid", F.posexplode("attachments").alias("att_no", "a"))
    return rows.select("source_name", "nid", "att_no", "a.*").withColumn("is_inline", F.col("is_inline") | F.col("hidden"))
