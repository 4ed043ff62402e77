"""Column expressions on text that several operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\f\r"


def whole(text: str | Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII texts take the fast path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; an empty array for a text without any."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))


def aside(df: DataFrame, new: Iterable[str]) -> DataFrame:
    """``df`` with every column that has one of the names in ``new`` (in any case) renamed: ``_input`` is added until the name is free.

    Operators that add columns call this first, so an input column of the same name is kept and nothing is ambiguous.
    """
    taken, out = {c.lower() for c in [*df.columns, *new]}, []
    for c in df.columns:
        name = c
        if c.lower() in {x.lower() for x in new}:
            while name.lower() in taken:
                name += "_input"
            taken.add(name.lower())
        out.append(name)
    return df.toDF(*out)
