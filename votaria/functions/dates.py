"""Calendar expressions: month arithmetic and publication lags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def published(start: Column, rule: str) -> Column:
    """The day on which a figure for the period that begins at ``start`` is out.

    ``same_day``, ``next_15`` and ``next_25`` (of the month after), ``second_end`` (end of the second month after),
    ``own_28`` (within the month), ``second_15``.
    """
    day = {"same_day": start, "next_15": F.date_add(F.add_months(start, 1), 14), "next_25": F.date_add(F.add_months(start, 1), 24), "second_end": F.last_day(F.add_months(start, 2)), "own_28": F.date_add(start, 27), "second_15": F.date_add(F.add_months(start, 2), 14)}
    return day[rule].cast("date")


def months(first: Column, last: Column) -> Column:
    """Every month from ``first`` to ``last``, as an array of first days."""
    return F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))
