"""Derived columns of a message: senders, recipients, flags, properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import first_of


def sender(name: Column, email: Column) -> Column:
    """`Name <address>`; one of them where the other is empty or the same but for case."""
    name, email = F.coalesce(name, F.lit("")), F.coalesce(email, F.lit(""))
    both = (name != "") & (email != "") & (F.lower(name) != F.lower(email))
    return F.when(both, F.concat(name, F.lit(" <"), email, F.lit(">"))).otherwise(first_of(name, email))


def best_address(*candidates: Column) -> Column:
    """The first candidate with an @, else the first that isn't empty."""
    return F.coalesce(*[F.when(F.contains(c, F.lit("@")), c) for c in candidates], first_of(*candidates))


def recipients_text(recipients: Column) -> Column:
    """All recipients (array of struct with name and email) in one line."""
    return F.array_join(F.filter(F.transform(recipients, lambda r: sender(r["name"], r["email"])), lambda s: s != ""), "; ")


def recipients_of(recipients: Column, kind: str) -> Column:
    """The names of the recipients of a kind, or addresses where there is no name."""
    return F.array_join(F.transform(F.filter(recipients, lambda r: r["kind"] == kind), lambda r: first_of(r["name"], r["email"])), "; ")


def mozilla_bit(status: Column, bit: int) -> Column:
    """A bit of X-Mozilla-Status: 1 is read, 8 is deleted."""
    return F.coalesce(F.conv(status, 16, 10).cast("long").bitwiseAND(bit) != 0, F.lit(False))


def importance(value: Column) -> Column:
    """2, 1 or 0 from Importance or X-Priority."""
    v = F.lower(F.coalesce(value, F.lit("")))
    return F.when(v.rlike("^(high|urgent|1|2)"), 2).when(v.rlike("^(low|non-urgent|4|5)"), 0).otherwise(1)


def filled(rows: DataFrame, opened: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Missing fields of listing rows from the opened messages."""
    more = opened.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = rows.join(more, key, "left")
    return joined.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}"), F.lit("")) for c in columns}).drop(*[f"_{c}" for c in columns])


def properties(rows: DataFrame, key: str, bag: str) -> DataFrame:
    """(key, name, value) of a property bag that is a map."""
    return rows.select(key, F.explode(bag).alias("name", "value"))


def named(properties: DataFrame, names: DataFrame, on: list[str]) -> DataFrame:
    """Property rows with the names that their source's name map gives; unknown ones keep a null name."""
    return properties.join(names, on, "left")
