"""Contacts from vCards (3.0, and 2.1 without its encodings), as column expressions: the inverse of `sinks.contacts.vcard`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A property's name behind an optional group; a part of a value up to a mark that isn't escaped.
NAME, PART = r"^(?:[\w-]+\.)?([A-Za-z0-9-]+)", r"((?:\\.|[^\\{0}])*)({0}|$)"


def unfolded(card: Column) -> Column:
    """The card's lines, continuations joined."""
    return F.filter(F.split(F.regexp_replace(card, "\r?\n[ \t]", ""), "\r?\n"), lambda s: F.trim(s) != "")


def unescaped(value: Column) -> Column:
    """A text value: escaped line feeds, commas, semicolons and backslashes."""
    value = F.replace(value, F.lit("\\\\"), F.lit("\x00"))
    for mark, text in (("\\n", "\n"), ("\\N", "\n"), ("\\,", ","), ("\\;", ";"), ("\\:", ":")):
        value = F.replace(value, F.lit(mark), F.lit(text))
    return F.replace(value, F.lit("\x00"), F.lit("\\"))


def parts(value: Column, mark: str) -> Column:
    """The parts of a structured value, unescaped."""
    found = F.regexp_extract_all(F.regexp_replace(value, "$", mark), F.lit(PART.format(mark)), F.lit(1))
    # The mark put behind ends the last part; the empty match behind it is none.
    return F.transform(F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0))), unescaped)


def _value(line: Column) -> Column:
    return F.regexp_extract(line, r"^(?:\"[^\"]*\"|[^:\"])*:(?s)(.*)$", 1)


def _kind(line: Column) -> Column:
    """The types of a number in lower case, `pref` only where it is the only one."""
    head = F.regexp_extract(line, r"^((?:\"[^\"]*\"|[^:\"])*):", 1)
    types = F.split(F.lower(F.regexp_replace(F.array_join(F.slice(F.split(head, ";"), F.lit(2), F.greatest(F.size(F.split(head, ";")) - 1, F.lit(0))), ","), "(?i)type=", "")), ",")
    types = F.filter(types, lambda t: (t != "") & ~t.rlike("="))
    others = F.filter(types, lambda t: t != "pref")
    return F.array_join(F.when(F.size(others) > 0, others).otherwise(types), ",")


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """A function of a value that is computed once, however often the function has it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def contact(card: Column) -> Column:
    """A struct of the card's fields, those that `vcard` takes; what is absent is empty."""

    def of(lines: Column) -> Column:
        named = lambda name: F.filter(lines, lambda s: s["name"] == name)
        first = lambda name: F.coalesce(_value(F.get(named(name), F.lit(0))["line"]), F.lit(""))
        return _once(F.struct(parts(first("N"), ";").alias("n"), parts(first("ORG"), ";").alias("o")), lambda x: fields_of(named, first, x["n"], x["o"]))

    def fields_of(named, first, name: Column, org: Column) -> Column:
        nth = lambda values, i: F.coalesce(F.get(values, F.lit(i)), F.lit(""))
        fields = {"display_name": unescaped(first("FN"))} | {k: nth(name, i) for i, k in enumerate(("surname", "given", "middle", "prefix", "suffix"))}
        fields |= {"nickname": unescaped(first("NICKNAME")), "company": nth(org, 0), "department": nth(org, 1), "title": unescaped(first("TITLE")), "profession": unescaped(first("ROLE"))}
        fields["phones"] = F.transform(named("TEL"), lambda s: F.struct(_kind(s["line"]).alias("kind"), unescaped(_value(s["line"])).alias("number")))
        fields["emails"] = F.transform(named("EMAIL"), lambda s: unescaped(_value(s["line"])))
        born = first("BDAY")
        fields["birthday"] = F.when(F.size(named("BDAY")) > 0, F.try_to_date(F.regexp_replace(F.substring(born, 1, 10), r"^(\d{4})(\d\d)(\d\d)$", "$1-$2-$3"), "yyyy-MM-dd"))
        fields["categories"] = F.filter(parts(first("CATEGORIES"), ","), lambda x: x != "")
        fields["notes"] = unescaped(first("NOTE"))
        return F.struct(*[c.alias(k) for k, c in fields.items()])

    # The names of lines are taken out once, not for each field.
    named = F.transform(unfolded(card), lambda s: F.struct(F.upper(F.regexp_extract(s, NAME, 1)).alias("name"), s.alias("line")))
    return _once(named, of)


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """(card) of each card in .vcf files, which may be large and are read in splits."""
    rows = spark.read.option("lineSep", "\nEND:VCARD").text(path)
    begun = F.regexp_extract("value", r"(?is)(BEGIN:VCARD.*)$", 1)
    return rows.select(begun.alias("card")).where("card != ''").select(F.concat("card", F.lit("\nEND:VCARD")).alias("card"))
