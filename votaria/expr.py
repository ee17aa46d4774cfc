"""Column expressions shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_form(col: Column | str) -> Column:
    """Ids are the same when equal after trimming and upper-casing; a blank id is no reference (null)."""
    c = F.upper(F.trim(F.col(col) if isinstance(col, str) else col))
    return F.when(c != "", c)


def day_of(col: Column | str) -> Column:
    """Date of a string that starts with yyyy-MM-dd or yyyyMMdd, with or without a time; null when unreadable."""
    c = F.col(col) if isinstance(col, str) else col
    digits = F.substring(F.regexp_replace(c, "[^0-9]", ""), 1, 8)
    return F.try_to_timestamp(F.when(F.length(digits) == 8, digits), F.lit("yyyyMMdd")).cast("date")


def period_start(col: Column | str) -> Column:
    """First day of a day, month (2024-03, 2024M03) or quarter (2024K1, 2024Q1) given as a string."""
    c = F.trim(F.col(col) if isinstance(col, str) else col)
    quarter = F.regexp_extract(c, r"^\d{4}-?[KkQq]([1-4])$", 1)
    month = F.regexp_extract(c, r"^\d{4}-?[Mm]?(\d{2})$", 1)
    text = (
        F.when(quarter != "", F.concat(F.substring(c, 1, 4), F.lpad(((F.try_to_number(quarter, F.lit("9")) - 1) * 3 + 1).cast("int").cast("string"), 2, "0"), F.lit("01")))
        .when(month != "", F.concat(F.substring(c, 1, 4), month, F.lit("01")))
        .otherwise(c)
    )
    return day_of(text)


def day_number(date: Column) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(date)


def rate(n: Column, d: Column, digits: int = 4) -> Column:
    """Share rounded to ``digits``; null where the denominator is zero."""
    return F.round(F.try_divide(n.cast("double"), d.cast("double")), digits)


def rounded(c: Column, digits: int) -> Column:
    """A double rounded as SQL engines do, by the product with a power of ten; ``round`` goes by its decimal form instead."""
    near = F.round(c * F.lit(10.0**digits)) / F.lit(10.0**digits)
    return F.when(F.isnan(near) | (F.abs(near) == float("inf")), c).otherwise(near)


def filled(col: Column | str) -> Column:
    """The text, or null when it is empty or blank."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.trim(c) != "", c)
