"""Bar quality and market-data coverage reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlab.functions.checks import PRICE_COLUMNS
from pitlab.functions.dates import day

GAP_DAYS = 5
VENDOR_GAP_DAYS = 14
RANGE_TOLERANCE_DAYS = 10


def price_windows(bars: DataFrame) -> DataFrame:
    """First and last session, first and last close and the number of bars per symbol."""
    return bars.groupBy("symbol").agg(
        F.min("session").alias("first_date"),
        F.max("session").alias("last_date"),
        F.min_by("close", "session").alias("first_close"),
        F.max_by("close", "session").alias("last_close"),
        F.count(F.lit(1)).alias("bars"),
    )


def _sessions_with_previous(bars: DataFrame) -> DataFrame:
    """Distinct sessions per symbol (at most one row per calendar day) and the one before."""
    w = Window.partitionBy("symbol").orderBy("session")
    return bars.select("symbol", "session").distinct().withColumn("previous", F.lag("session").over(w))


def bar_gaps(bars: DataFrame, longer_than: int = GAP_DAYS) -> DataFrame:
    """Pairs of consecutive sessions more than ``longer_than`` days apart."""
    return (
        _sessions_with_previous(bars)
        .withColumn("days", F.datediff("session", "previous"))
        .filter(F.col("days") > longer_than)
        .select("symbol", "previous", "session", "days")
    )


def bar_quality(bars: DataFrame, gap_days: int = GAP_DAYS) -> DataFrame:
    """Defects per symbol, and one row for the whole table (symbol NULL).

    Raw bars may repeat a stamp without limit, so they are folded to one row per
    (symbol, ts) and then per session before anything is ordered.
    """
    flawed = F.lit(False)
    for c in PRICE_COLUMNS:
        flawed = flawed | F.coalesce(F.col(c) <= 0, F.lit(False))
    per_stamp = bars.groupBy("symbol", "session", "ts").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("adjusted_close").isNull()).alias("no_adjusted"),
        F.count_if(flawed).alias("bad_price"),
        F.count_if(F.col("volume") <= 0).alias("bad_volume"),
    )
    per_session = per_stamp.groupBy("symbol", "session").agg(
        F.sum("n").alias("n"),
        (F.sum("n") - F.count(F.lit(1))).alias("repeated"),
        F.sum("no_adjusted").alias("no_adjusted"),
        F.sum("bad_price").alias("bad_price"),
        F.sum("bad_volume").alias("bad_volume"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    w = Window.partitionBy("symbol").orderBy("session")
    gap = F.coalesce(F.datediff("session", F.lag("session").over(w)) > gap_days, F.lit(False))
    return (
        per_session.withColumn("gap", gap)
        .groupingSets([["symbol"], []], "symbol")
        .agg(
            F.when(F.grouping("symbol") == 1, "total").otherwise(F.col("symbol")).alias("level"),
            F.sum("n").alias("bar_count"),
            F.min("first_ts").alias("first_timestamp"),
            F.max("last_ts").alias("last_timestamp"),
            F.sum("repeated").alias("duplicates"),
            F.sum("no_adjusted").alias("missing_adjusted_close"),
            F.sum("bad_price").alias("non_positive_price"),
            F.sum("bad_volume").alias("non_positive_volume"),
            F.count_if("gap").alias("suspicious_gaps"),
        )
    )


def incomplete_range(first: Column, last: Column, start: Column, end: Column) -> Column:
    """No bars, or an end of the series more than ten days inside the requested range."""
    return (
        first.isNull()
        | (first > F.date_add(start, RANGE_TOLERANCE_DAYS))
        | (last < F.date_sub(end, RANGE_TOLERANCE_DAYS))
    )


def market_data_coverage(
    symbols: DataFrame, bars: DataFrame, start: date, end: date, lookback: int, origins: DataFrame | None = None
) -> DataFrame:
    """Coverage per requested symbol, and totals (symbol NULL) as a rollup.

    ``origins`` (symbol, origin) are import results; without one a symbol is available or missing.
    """
    inside = bars.filter((F.col("session") >= F.lit(start)) & (F.col("session") <= F.lit(end)))
    per_symbol = inside.groupBy("symbol").agg(
        F.min("session").alias("first_date"),
        F.max("session").alias("last_date"),
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("adjusted_close").isNull()).alias("missing_adjusted_close"),
    )
    rows = symbols.select("symbol").distinct().join(per_symbol, "symbol", "left").fillna(0, ["row_count", "missing_adjusted_close"])
    has = F.col("row_count") > 0
    status = F.when(has, "available").otherwise("missing")
    if origins is not None:
        rows = rows.join(origins.select("symbol", F.lower("origin").alias("_o")), "symbol", "left")
        status = F.coalesce("_o", status)
    rows = rows.withColumn("download_status", status)
    cut_short = has & incomplete_range(F.col("first_date"), F.col("last_date"), day(start), day(end))
    return rows.rollup("symbol").agg(
        F.when(F.grouping("symbol") == 1, "total").otherwise(F.col("symbol")).alias("level"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        F.sum("row_count").alias("row_count"),
        F.sum("missing_adjusted_close").alias("missing_adjusted_close"),
        F.when(F.grouping("symbol") == 0, F.min("download_status")).alias("download_status"),
        F.count(F.lit(1)).alias("symbols"),
        F.count_if(has).alias("with_prices"),
        F.count_if(~has).alias("without_prices"),
        F.count_if(cut_short).alias("incomplete_range"),
        F.count_if(has & (F.col("row_count") < lookback + 1)).alias("insufficient_history"),
    )


def last_bars(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(
        F.max("session").alias("last_bar"), F.max_by("close", "session").alias("last_close")
    )


def unusable_symbols(bars: DataFrame, rules: list[tuple[Column, str]] | None = None) -> DataFrame:
    """(symbol, reason) of series that a rule over their price window rejects.

    There is no rule by default: a high price is valid, and an empty series is missing,
    not unusable.
    """
    windows = price_windows(bars)
    reason = F.lit(None).cast("string")
    for condition, name in reversed(rules or []):
        reason = F.when(condition, name).otherwise(reason)
    return windows.select("symbol", reason.alias("reason")).filter(F.col("reason").isNotNull())
