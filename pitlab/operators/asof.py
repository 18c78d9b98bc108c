"""Backward as-of joins, without a range join.

The join works on days. Both sides are first reduced to one row per (key, day), so a
window over one key sees at most one row per calendar day, however many rows the key has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlab.functions.dates import month_of


def asof_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_day: str,
    right_day: str,
    tie_order: list[Column | str] | None = None,
    prefix: str = "",
) -> DataFrame:
    """For each left row, the latest right row of the key with right_day <= left_day.

    ``tie_order`` picks the last right row of a day. Right columns other than the key
    come back under ``prefix``; they are NULL when nothing precedes the left day.
    """
    carried = [c for c in right.columns if c != key]
    order = [F.col(o) if isinstance(o, str) else o for o in (tie_order or [c for c in carried if c != right_day])]
    order = order or [F.col(right_day)]
    per_day = right.groupBy(key, F.col(right_day).alias("_day")).agg(
        F.max_by(F.struct(*carried), F.struct(*order)).alias("_match")
    )
    asked = left.select(key, F.col(left_day).alias("_day")).distinct()
    both = per_day.withColumn("_asked", F.lit(False)).unionByName(
        asked.withColumn("_asked", F.lit(True)), allowMissingColumns=True
    )
    # On one day the stored row sorts before the question, so it may answer it.
    w = Window.partitionBy(key).orderBy("_day", "_asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    answered = (
        both.withColumn("_found", F.last("_match", ignorenulls=True).over(w))
        .filter("_asked")
        .select(key, F.col("_day").alias(left_day), "_found")
    )
    joined = left.join(answered, [key, left_day], "left")
    return joined.select(*left.columns, *[F.col(f"_found.{c}").alias(f"{prefix}{c}") for c in carried])


def asof_stored(
    left: DataFrame, stored: DataFrame, key: str, left_day: str, right_day: str, tie_order: list[Column | str] | None = None, prefix: str = "", month: str = "month"
) -> DataFrame:
    """``asof_join`` with a table that ``write_bucketed`` stored by (key, month): its rows are not shuffled.

    A question is answered from its own month, else by the last row of an earlier month. The first is an equi-join on the bucket
    columns, to which Spark brings the questions; it pairs a question with at most a month of its key. The second needs one row
    per key and month, aggregated inside the buckets. A hot key lies in as many buckets as it has months.

    Rows of ``stored`` with a NULL key or day answer nothing.
    """
    carried = [c for c in stored.columns if c not in (key, month)]
    order = [F.col(o) if isinstance(o, str) else o for o in (tie_order or [c for c in carried if c != right_day])]
    latest = F.struct(F.col(right_day), *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    match = F.max_by(F.struct(*carried), latest).alias("_match")
    asked = left.select(key, F.col(left_day).alias("_day")).distinct().withColumn(month, month_of("_day"))
    inside = asked.join(stored, [key, month]).filter(F.col(right_day) <= F.col("_day")).groupBy(key, month, "_day").agg(match)
    closing = stored.filter(F.col(right_day).isNotNull()).groupBy(key, month).agg(match)
    months = closing.unionByName(asked.select(key, month).distinct(), allowMissingColumns=True)
    # At most a row per month of the calendar and key: what the months before leave.
    before = Window.partitionBy(key).orderBy(month).rangeBetween(Window.unboundedPreceding, -1)
    carried_in = months.withColumn("_before", F.last("_match", ignorenulls=True).over(before)).groupBy(key, month).agg(F.first("_before", ignorenulls=True).alias("_before"))
    found = asked.join(inside.withColumnRenamed("_match", "_inside"), [key, month, "_day"], "left").join(carried_in, [key, month], "left")
    answered = found.select(key, F.col("_day").alias(left_day), F.coalesce("_inside", "_before").alias("_found"))
    joined = left.join(answered, [key, left_day], "left")
    return joined.select(*left.columns, *[F.col(f"_found.{c}").alias(f"{prefix}{c}") for c in carried])


def count_before(calendar: DataFrame, dates: DataFrame, date_col: str = "as_of") -> DataFrame:
    """For each session, how many of ``dates`` lie strictly before it. Both are calendars."""
    marks = calendar.select(F.col("session").alias("d"), F.lit(0).alias("hit")).unionByName(
        dates.select(F.col(date_col).alias("d"), F.lit(1).alias("hit"))
    )
    days = marks.groupBy("d").agg(F.max("hit").alias("hit"), F.min("hit").alias("low"))
    w = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    return (
        days.withColumn("before", F.coalesce(F.sum("hit").over(w), F.lit(0)).cast("int"))
        .filter(F.col("low") == 0)
        .select(F.col("d").alias("session"), "before")
    )
