"""Contact cards (vCard 3.0) and their table, from columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import first_of, vcard_escape


@F.pandas_udf(StringType())
def _folded(card: pd.Series) -> pd.Series:
    """Lines over 75 octets are continued after a blank; characters stay whole."""

    def fold(line: str) -> str:
        if len(line) <= 75 and len(line.encode()) <= 75:
            return line
        out, used = [], 0
        for ch in line:
            n = len(ch.encode())
            if used + n > 75:
                out.append("\r\n ")
                used = 1
            out.append(ch)
            used += n
        return "".join(out)

    return card.map(lambda s: "\r\n".join(map(fold, s.split("\r\n"))), na_action="ignore")


def vcard(c: dict[str, Column], revision: Column | None) -> Column:
    """A card of the fields given: display_name, surname, given, middle, prefix, suffix, nickname, company, department,
    title, profession, phones (array of struct<kind, number>), emails (array), birthday (date), categories, notes."""
    get = lambda k: F.coalesce(c[k], F.lit("")) if k in c else F.lit("")
    emails = c.get("emails", F.array().cast("array<string>"))
    full = F.array_join(F.filter(F.array(*map(get, ("prefix", "given", "middle", "surname", "suffix"))), lambda x: x != ""), " ")
    name = first_of(get("display_name"), full, get("company"), F.get(emails, F.lit(0)), F.lit("contact"))
    some = lambda label, value: F.when(value != "", F.concat(F.lit(label), vcard_escape(value)))
    lines = [
        F.lit("BEGIN:VCARD"), F.lit("VERSION:3.0"), F.concat(F.lit("FN:"), vcard_escape(name)),
        F.concat(F.lit("N:"), F.concat_ws(";", *[vcard_escape(get(k)) for k in ("surname", "given", "middle", "prefix", "suffix")])),
        some("NICKNAME:", get("nickname")),
        F.when((get("company") != "") | (get("department") != ""), F.concat(F.lit("ORG:"), vcard_escape(get("company")), F.when(get("department") != "", F.concat(F.lit(";"), vcard_escape(get("department")))).otherwise(""))),
        some("TITLE:", get("title")), some("ROLE:", get("profession")),
    ]
    several = []
    if "phones" in c:
        several.append(F.transform(c["phones"], lambda p, i: F.concat(F.lit("TEL;TYPE="), F.upper(p["kind"]), F.when((i == 0) & ~F.contains(F.upper(p["kind"]), F.lit("PREF")), ",PREF").otherwise(""), F.lit(":"), vcard_escape(p["number"]))))
    several.append(F.transform(emails, lambda e, i: F.concat(F.lit("EMAIL;TYPE=INTERNET"), F.when(i == 0, ",PREF").otherwise(""), F.lit(":"), vcard_escape(e))))
    tail = []
    if "birthday" in c:
        tail.append(F.concat(F.lit("BDAY:"), F.date_format(c["birthday"], "yyyy-MM-dd")))
    if "categories" in c:
        tail.append(F.when(F.size(c["categories"]) > 0, F.concat(F.lit("CATEGORIES:"), F.array_join(F.transform(c["categories"], vcard_escape), ","))))
    tail += [some("NOTE:", get("notes"))]
    if revision is not None:
        tail.append(F.concat(F.lit("REV:"), F.date_format(revision, "yyyyMMdd'T'HHmmss'Z'")))
    body = F.concat(F.array_compact(F.array(*lines)), *[F.coalesce(s, F.array().cast("array<string>")) for s in several], F.array_compact(F.array(*tail, F.lit("END:VCARD"))))
    card = F.concat(F.array_join(body, "\r\n"), F.lit("\r\n"))
    # Cards whose lines all fit need no folding and so no Python.
    return F.when(F.exists(F.split(card, "\r\n"), lambda s: F.octet_length(s) > 75), _folded(card)).otherwise(card)


def write_cards(cards: DataFrame, path: str) -> None:
    """Combined .vcf files, one a partition; card is the only column that is written."""
    cards.select(F.regexp_replace("card", "\r\n$", "").alias("card")).write.option("lineSep", "\r\n").text(path)


def write_table(contacts: DataFrame, path: str) -> None:
    contacts.write.option("header", True).csv(path)


# Which phone of which kind goes to which column of the table.
PHONES = {
    "business_phone": ("work", 0), "business_phone2": ("work", 1), "home_phone": ("home", 0), "home_phone2": ("home", 1), "mobile_phone": ("cell", 0), "primary_phone": ("pref", 0),
    "other_phone": ("voice", 0), "pager": ("pager", 0), "business_fax": ("work,fax", 0), "home_fax": ("home,fax", 0), "company_phone": ("work,voice", 0), "assistant_phone": ("assistant", 0),
}
ADDRESS_PARTS = ["street", "city", "state", "postcode", "country", "po_box"]


def phone_columns(phones: Column) -> dict[str, Column]:
    """The phones of a contact (array of struct<kind, number>) by the table's columns; absent ones are empty."""

    def phone(kind: str, n: int) -> Column:
        return F.coalesce(F.get(F.filter(phones, lambda p: p["kind"] == kind), F.lit(n))["number"], F.lit(""))

    return {name: phone(kind, n) for name, (kind, n) in PHONES.items()}


def email_columns(emails: Column) -> dict[str, Column]:
    return {f"email{i + 1}": F.coalesce(F.get(emails, F.lit(i)), F.lit("")) for i in range(3)}


def address_line(address: Column) -> Column:
    """One line of an address struct: box, street, city, state, postcode, country; empty parts left out."""
    parts = F.array(*[F.coalesce(F.replace(address[p], F.lit("\n"), F.lit(", ")), F.lit("")) for p in ("po_box", "street", "city", "state", "postcode", "country")])
    return F.array_join(F.filter(parts, lambda p: p != ""), ", ")


def contact_text(fields: dict[str, Column]) -> Column:
    """A readable card: `Label: value` lines of the fields that aren't empty, in their order."""
    lines = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), c)) for label, c in fields.items()]
    return F.concat_ws("\n", *lines)
