"""Scalar helpers with the null and zero rules of the analyses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def text(c: Column) -> Column:
    """Trimmed text, blank as null."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def number(c: Column) -> Column:
    """A double, 0 where it can't be read."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def timestamp(c: Column) -> Column:
    """A timestamp without zone from a text that starts with a full date."""
    trimmed = text(c)
    return F.when(trimmed.rlike("^\\d{4}-\\d{1,2}-\\d{1,2}"), trimmed.try_cast("timestamp_ntz"))


def seconds(ts: Column) -> Column:
    """Whole seconds since the epoch; differences count second boundaries.

    The session's time zone must be UTC for timestamps without zone.
    """
    return F.unix_seconds(ts.cast("timestamp"))


def ratio(part: Column, whole: Column, digits: int | None = None) -> Column:
    """A quotient that is 0 where there is nothing to divide by."""
    value = F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole)
    return value if digits is None else F.round(value, digits)


def filled(c: Column) -> Column:
    """Null where blank."""
    return F.when(c != "", c)
