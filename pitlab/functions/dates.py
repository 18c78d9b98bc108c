"""Date predicates. Three interval readings exist and must not be mixed up:
half-open containment, overlap with an inclusive window, and inclusive containment."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitlab.schemas import OPEN_END


def day(value: date | str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def effective_end(end: Column) -> Column:
    return F.coalesce(end, day(OPEN_END))


def valid_at(start: Column, end: Column, d: Column | date) -> Column:
    """Half-open: start <= d < end, a NULL end meaning still open."""
    at = day(d)
    return (start <= at) & (end.isNull() | (at < end))


def overlaps_window(start: Column, end: Column, w_start: Column | date, w_end: Column | date) -> Column:
    """Half-open interval against an inclusive window."""
    return (start <= day(w_end)) & (end.isNull() | (day(w_start) < end))


def valid_through(start: Column, end: Column, d: Column) -> Column:
    """Inclusive on both sides, closed intervals only (used for listing terminations)."""
    return (start <= d) & end.isNotNull() & (d <= end)


def overlap_days(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Days shared by two half-open intervals."""
    return F.greatest(F.lit(0), F.datediff(F.least(a_end, b_end), F.greatest(a_start, b_start)))


def parse_snapshot_date(c: Column) -> Column:
    """ISO (dashed or compact), then month/day/year with slashes or dashes."""
    text = F.trim(c)
    return F.coalesce(
        F.try_to_date(text, "yyyy-MM-dd"),
        F.try_to_date(text, "yyyyMMdd"),
        F.try_to_date(text, "M/d/yyyy"),
        F.try_to_date(text, "M-d-yyyy"),
    )


def has_offset(raw: Column) -> Column:
    """The text names a UTC offset. Spark would silently read a naive text in session time."""
    return F.trim(raw).rlike(r"[Tt ].*(Z|z|[+-][0-9]{2}:?[0-9]{2})$")


def midpoint(start: Column, end: Column, horizon: Column | date) -> Column:
    """Middle day of an interval; an open one ends at the horizon."""
    span = F.datediff(F.coalesce(end, day(horizon)), start)
    return F.date_add(start, F.floor(F.greatest(span, F.lit(0)) / 2).cast("int"))


def month_of(day: str) -> Column:
    """Months since year 0: the number by which stored tables are bucketed."""
    return (F.year(day) * 12 + F.month(day)).cast("int")
