"""Half-open intervals: building, expanding to dates, overlap checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlab.functions.dates import effective_end
from pitlab.schemas import OPEN_END


def snapshots_to_intervals(snapshots: DataFrame) -> DataFrame:
    """(change_date, symbol) rows to (symbol, start_date, end_date).

    A symbol opens where it enters, closes at the change date where it is gone, opens a
    new row on re-entry, and has a NULL end if the last snapshot still lists it.
    """
    days = Window.orderBy("change_date")
    dates = snapshots.select("change_date").distinct().select(
        "change_date",
        F.row_number().over(days).alias("_i"),
        F.lead("change_date").over(days).alias("_after"),
    )
    rows = snapshots.select("change_date", "symbol").distinct().join(F.broadcast(dates), "change_date")
    # At most one row per symbol and change date: bounded by the calendar.
    own = Window.partitionBy("symbol").orderBy("_i")
    islands = rows.withColumn("_island", F.col("_i") - F.row_number().over(own))
    return islands.groupBy("symbol", "_island").agg(
        F.min("change_date").alias("start_date"), F.max_by("_after", "_i").alias("end_date")
    ).drop("_island")


def expand_to_dates(
    intervals: DataFrame, dates: DataFrame, start: str = "start_date", end: str = "end_date", date_col: str = "as_of"
) -> DataFrame:
    """Every (interval, date) with start <= date < end, as an equi-join on the month.

    Each interval is opened into the months it touches, clipped to the span of
    ``dates``; the dates are a calendar, so they are broadcast. The work is the size of
    the result, and no interval meets a date outside its months.
    """
    span = dates.agg(F.min(date_col).alias("lo"), F.max(date_col).alias("hi"))
    lo = F.greatest(F.col(start), span.select("lo").scalar())
    hi = F.least(effective_end(F.col(end)), F.date_add(span.select("hi").scalar(), 1))
    clipped = intervals.withColumn("_lo", lo).withColumn("_hi", hi).filter(F.col("_lo") < F.col("_hi"))
    months = clipped.withColumn(
        "_month",
        F.explode(
            F.sequence(F.trunc("_lo", "MM"), F.trunc(F.date_sub("_hi", 1), "MM"), F.expr("interval 1 month"))
        ),
    )
    # One row per day at most, whatever was passed in: that bounds the broadcast.
    calendar = F.broadcast(dates.dropDuplicates([date_col]).withColumn("_month", F.trunc(date_col, "MM")))
    return (
        months.join(calendar, "_month")
        .filter((F.col("_lo") <= F.col(date_col)) & (F.col(date_col) < F.col("_hi")))
        .drop("_month", "_lo", "_hi")
    )


def expand_to_sessions(
    spans: DataFrame, calendar: DataFrame, start: str = "start_date", end: str = "end_date"
) -> DataFrame:
    """Every (span, session) with start <= session < end, for spans that start and end on sessions.

    Both ends become calendar positions through a broadcast calendar, and the span opens
    into the positions between them: no row is made that the result does not hold.
    """
    days = calendar.select("session", "idx")
    beyond = days.agg(F.max("idx") + 1).scalar()
    first = F.broadcast(days.select(F.col("session").alias(start), F.col("idx").alias("_i0")))
    last = F.broadcast(days.select(F.col("session").alias(end), F.col("idx").alias("_i1")))
    placed = spans.join(first, start).join(last, end, "left")
    opened = placed.withColumn("idx", F.explode(F.sequence(F.col("_i0"), F.coalesce("_i1", beyond) - 1)))
    return opened.join(F.broadcast(days), "idx").drop("idx", "_i0", "_i1")


def overlap_counts(intervals: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Distinct intervals, each with the number of copies and of other intervals it overlaps.

    Counted by sweeping days rather than by pairing rows: an interval [s, e) overlaps
    those that start before e, less those that ended by s, less itself. Day totals are
    summed before the shuffle, and each key then has at most one row per calendar day.
    Inverted intervals overlap nothing and are reported by ``impossible``.
    """
    distinct = intervals.groupBy(*keys, start, end).agg(F.count(F.lit(1)).alias("copies"))
    stop = effective_end(F.col(end))
    sound = distinct.withColumn("_stop", stop).withColumn("impossible", F.col(start) >= F.col("_stop"))
    proper = sound.filter(~F.col("impossible"))
    marks = proper.select(*keys, F.col(start).alias("_d"), F.lit(1).alias("_s"), F.lit(0).alias("_e")).unionByName(
        proper.select(*keys, F.col("_stop").alias("_d"), F.lit(0).alias("_s"), F.lit(1).alias("_e"))
    )
    days = marks.groupBy(*keys, "_d").agg(F.sum("_s").alias("_s"), F.sum("_e").alias("_e"))
    before = Window.partitionBy(*keys).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    through = Window.partitionBy(*keys).orderBy("_d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = days.select(
        *keys,
        "_d",
        F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_started"),
        F.sum("_e").over(through).alias("_ended"),
    )
    at_stop = swept.select(*keys, F.col("_d").alias("_stop"), "_started")
    at_start = swept.select(*keys, F.col("_d").alias(start), "_ended")
    counted = sound.join(at_stop, [*keys, "_stop"], "left").join(at_start, [*keys, start], "left")
    overlaps = F.when(F.col("impossible"), F.lit(0)).otherwise(F.col("_started") - F.col("_ended") - 1)
    return counted.select(*keys, start, end, "copies", overlaps.cast("long").alias("overlap_count"), "impossible")


def timeline(intervals: DataFrame, keys: Sequence[str], start: str, end: str, carry: Sequence[Column | str]) -> DataFrame:
    """Stretches of each key that exactly one interval covers, with the ``carry`` columns of it.

    Returns keys, ``seg_from``, ``seg_to`` (exclusive, NULL if open) and the carried columns;
    stretches never overlap, so a day meets at most one. Days are swept in order with the
    number of intervals open and the sum of their row hashes: where one is open, the sum is
    its hash. Each key has at most one row per calendar day, and no interval meets another.
    """
    sound = intervals.filter(F.col(start) < effective_end(F.col(end)))
    rows = sound.select(
        *[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)],
        F.col(start).alias("_from"),
        effective_end(F.col(end)).alias("_to"),
        F.struct(*carry).alias("_row"),
    )
    names = [f"_k{n}" for n in range(len(keys))]
    rows = rows.withColumn("_h", F.xxhash64(*names, "_from", "_to", "_row").cast("decimal(20,0)"))
    marks = rows.select(*names, F.col("_from").alias("_d"), F.lit(1).alias("_n"), "_h").unionByName(
        rows.select(*names, F.col("_to").alias("_d"), F.lit(-1).alias("_n"), (-F.col("_h")).alias("_h"))
    )
    days = marks.groupBy(*names, "_d").agg(F.sum("_n").alias("_n"), F.sum("_h").cast("decimal(38,0)").alias("_h"))
    w = Window.partitionBy(*names).orderBy("_d")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    single = (
        days.select(
            *names, F.col("_d").alias("seg_from"), F.lead("_d").over(w).alias("_next"),
            F.sum("_n").over(run).alias("_open"), F.sum("_h").over(run).cast("decimal(20,0)").alias("_h"),
        )
        .filter(F.col("_open") == 1)
        .drop("_open")
    )
    segments = single.join(rows.select(*names, "_h", "_row"), [*names, "_h"])
    return segments.select(
        *[F.col(n).alias(k) for n, k in zip(names, keys)],
        "seg_from",
        F.nullif("_next", F.lit(OPEN_END).cast("date")).alias("seg_to"),
        "_row.*",
    )


def latest_end(end: str) -> Column:
    """Aggregate: NULL if any interval is open, else the greatest end."""
    return F.when(F.bool_or(F.col(end).isNull()), F.lit(None).cast("date")).otherwise(F.max(end))
