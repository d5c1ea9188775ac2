"""The listing filter: one conjunctive predicate over listing rows, compiled to columns.

`compile` gives the parts that need listing columns only, so they reach the scan; a kind of attachment is a
left-semi join with the attachments, and words missing from the header may be found in the body.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import listing_bound, timestamp
from ..functions.text import extension

# Extensions by kind.
DOCUMENTS = "pdf doc docx docm dot dotx rtf odt ott pages xls xlsx xlsm xlsb ods csv numbers ppt pptx pptm pps ppsx odp key txt md epub xps oxps one vsd vsdx pub mpp".split()
IMAGES = "jpg jpeg png gif bmp tif tiff webp heic heif svg ico psd ai raw cr2 nef emf wmf".split()
ARCHIVES = "zip 7z rar gz tgz tar bz2 xz z cab iso dmg jar".split()


def attachment_kind(name: Column) -> Column:
    ext = extension(name)
    return F.when(ext.isin(DOCUMENTS), "documents").when(ext.isin(IMAGES), "images").when(ext.isin(ARCHIVES), "archives").otherwise("other")


def parse_extensions(text: str) -> set[str]:
    return {p.lstrip(".").lower() for p in re.split(r"[,;\s]+", text or "") if p.lstrip(".")}


def _class(mc: Column) -> Column:
    return F.upper(F.coalesce(F.nullif(mc, F.lit("")), F.lit("IPM.Note")))


def is_contact(mc: Column) -> Column:
    return F.coalesce(F.startswith(F.upper(mc), F.lit("IPM.CONTACT")), F.lit(False))


def is_mail(mc: Column) -> Column:
    """Notes, reports and posts; an empty class counts as a note."""
    u = _class(mc)
    return F.startswith(u, F.lit("IPM.NOTE")) | F.startswith(u, F.lit("REPORT.")) | (u == "IPM") | F.startswith(u, F.lit("IPM.POST"))


def item_kind(mc: Column) -> Column:
    u = _class(mc)
    starts = lambda *p: reduce(lambda a, b: a | b, [F.startswith(u, F.lit(x)) for x in p])
    return (
        F.when(is_mail(mc), "e-mail").when(starts("IPM.CONTACT"), "contact")
        .when(starts("IPM.APPOINTMENT", "IPM.SCHEDULE"), "appointment / meeting").when(starts("IPM.TASK"), "task")
        .when(starts("IPM.STICKYNOTE"), "note").when(starts("IPM.ACTIVITY"), "journal")
        .when(starts("IPM.DISTLIST"), "distribution list").otherwise("other")
    )


@dataclass
class RowFilter:
    text: str = ""
    search_body: bool = False
    since: str | None = None
    until: str | None = None
    has_attachments: bool = False
    attachment_type: str = "all"
    contacts_only: bool = False
    only_mail: bool = False

    @property
    def terms(self) -> list[str]:
        return self.text.lower().split()

    def date_part(self) -> Column | None:
        """Inclusive on both sides; rows without a date only pass where there is no bound."""
        since, until = listing_bound(self.since), listing_bound(self.until, end=True)
        parts = [F.col("date") >= timestamp(since)] if since else []
        parts += [F.col("date") <= timestamp(until)] if until else []
        return reduce(lambda a, b: a & b, parts) if parts else None

    def compile(self, columns: list[str], body_cap: int | None = None) -> Column:
        """With body_cap, terms are looked for in so many characters of a body only (the reference: 65,536)."""
        body = F.col("body") if body_cap is None else F.substring("body", 1, body_cap)
        parts: list[Column] = []
        if self.only_mail:
            parts.append(is_mail(F.col("message_class")))
        if self.contacts_only:
            parts.append(is_contact(F.col("message_class")))
        if (d := self.date_part()) is not None:
            parts.append(d)
        if self.has_attachments:
            parts.append(F.col("has_attachments"))
        header = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("subject", "sender", "to") if c in columns]))
        for term in self.terms:
            found = F.contains(header, F.lit(term))
            if self.search_body:
                found |= F.coalesce(F.contains(F.lower(body), F.lit(term)), F.lit(False))
            parts.append(found)
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    def apply(self, listing: DataFrame, attachments: DataFrame | None = None) -> DataFrame:
        """Rows that pass. listing has a `body` column if bodies are searched; attachments (nid, filename, is_inline)."""
        rows = listing.where(self.compile(listing.columns))
        if self.attachment_type in ("", "all"):
            return rows
        wanted = attachments.where(~F.col("is_inline") & (attachment_kind(F.col("filename")) == self.attachment_type))
        return rows.join(wanted.select("nid"), "nid", "left_semi")

    def describe(self) -> str:
        parts = [f"'{self.text.strip()}'" + " in bodies too" * self.search_body] if self.terms else []
        if self.date_part() is not None:
            parts.append(f"dated {self.since or '…'} to {self.until or '…'}")
        parts += ["with attachments"] * self.has_attachments + [self.attachment_type] * (self.attachment_type not in ("", "all"))
        return ", ".join(parts + ["contacts"] * self.contacts_only + ["e-mail only"] * self.only_mail)


def folder_subtree(listing: DataFrame, wanted: str) -> DataFrame:
    """Rows of folders whose last path components equal the wanted ones, or that lie below such a folder; each nid once."""
    want = [p for p in re.split(r"[/\\]", wanted.lower()) if p]
    parts = F.split(F.lower("folder"), "/")
    here = F.exists(F.sequence(F.lit(1), F.size(parts)), lambda i: F.slice(parts, i, len(want)) == F.array(*map(F.lit, want)))
    return listing.where(here).dropDuplicates(["source_name", "nid"])


def wanted_attachments(attachments: DataFrame, extensions: str = "", kinds: tuple[str, ...] = (), skip_inline: bool = False) -> DataFrame:
    """What an attachments-only export keeps; embedded messages count as .eml."""
    name = F.col("filename")
    rows = attachments
    if "is_embedded" in attachments.columns:
        name = F.when(F.col("is_embedded") & ~F.endswith(F.lower(name), F.lit(".eml")), F.concat(name, F.lit(".eml"))).otherwise(name)
        if skip_inline:
            rows = rows.where(~F.col("is_inline") | F.col("is_embedded"))
    elif skip_inline:
        rows = rows.where(~F.col("is_inline"))
    if found := parse_extensions(extensions):
        rows = rows.where(extension(name).isin(sorted(found)))
    if kinds:
        rows = rows.where(attachment_kind(name).isin(list(kinds)))
    return rows
