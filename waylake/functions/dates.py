"""Date functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_date(c: Column) -> Column:
    """The calendar date written yyyy-MM-dd, else null."""
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def chinese_date(c: Column) -> Column:
    """The first date written as 2025年12月31日 in a text, else null."""
    part = [F.regexp_extract(c, r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日", i) for i in (1, 2, 3)]
    return F.when(part[0] != "", F.try_to_date(F.concat_ws("-", part[0], F.lpad(part[1], 2, "0"), F.lpad(part[2], 2, "0")), "yyyy-MM-dd"))


def first_ten(c: Column) -> Column:
    """A date or timestamp text cut to its day; null gives the empty text."""
    return F.coalesce(F.substring(c, 1, 10), F.lit(""))


def dotted(c: Column) -> Column:
    """yyyy-MM-dd as yyyy.MM.dd, anything else unchanged."""
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.translate(c, "-", ".")).otherwise(c)


def utc_stamp(c: Column) -> Column:
    """A timestamp as ISO text in UTC to the second (the session's zone must be UTC)."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
