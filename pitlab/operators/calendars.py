"""Trading calendars and rebalance dates.

A calendar holds at most one row per day (36,525 in a century, under 2 MB), whatever
the size of the bar table, so it is the one kind of table broadcast without a check.
A window without a partition key is used on calendars only.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def trading_calendar(bars: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """Distinct sessions with idx from 1, the session before and the session after."""
    sessions = bars.select("session")
    if start is not None:
        sessions = sessions.filter(F.col("session") >= F.lit(start))
    if end is not None:
        sessions = sessions.filter(F.col("session") <= F.lit(end))
    w = Window.orderBy("session")
    return sessions.distinct().select(
        "session",
        F.row_number().over(w).cast("long").alias("idx"),
        F.lag("session").over(w).alias("prev_session"),
        F.lead("session").over(w).alias("next_session"),
    )


def rebalance_dates(calendar: DataFrame, warmup_sessions: int = 1, signal_start: date | None = None) -> DataFrame:
    """First session of each month after warm-up: (as_of, execution session, n from 1).

    The very first session counts as a month start. The execution session is the next
    one, NULL for a signal on the last session.
    """
    prev = F.col("prev_session")
    month_start = prev.isNull() | (F.trunc("session", "MM") != F.trunc("prev_session", "MM"))
    picked = calendar.filter(month_start & (F.col("idx") >= warmup_sessions))
    if signal_start is not None:
        picked = picked.filter(F.col("session") >= F.lit(signal_start))
    return picked.select(
        F.col("session").alias("as_of"),
        F.col("next_session").alias("execution_session"),
        F.row_number().over(Window.orderBy("session")).cast("long").alias("n"),
    )


def month_starts(spark: SparkSession, start: date, end: date) -> DataFrame:
    """First day of each month in [start, end], and ``start`` itself; empty if start > end."""
    if start > end:
        return spark.createDataFrame([], "as_of date")
    days = F.sequence(F.trunc(F.lit(start), "MM"), F.lit(end), F.expr("interval 1 month"))
    firsts = F.filter(days, lambda d: d >= F.lit(start))
    return spark.range(1).select(F.explode(F.array_union(F.array(F.lit(start)), firsts)).alias("as_of"))


def session_timestamps(bars: DataFrame) -> DataFrame:
    """Opening stamp of each session: 09:30 on the day of its earliest bar."""
    return bars.groupBy("session").agg(
        (F.date_trunc("day", F.min("ts")) + F.expr("interval 9 hours 30 minutes")).alias("session_ts")
    )
