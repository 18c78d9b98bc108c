"""Planning and summarising imports of daily bars for any number of symbols at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pitlab.plans.quality import RANGE_TOLERANCE_DAYS, incomplete_range
from pitlab.session import materialize


def import_plan(windows: DataFrame, requests: DataFrame) -> DataFrame:
    """What each request (symbol, start, end) still has to fetch, given stored price windows.

    ``cached``: the head of the series is within ten days of the start. ``prefix``: fetch up
    to the day before the first stored bar. ``full``: nothing is stored.
    """
    first = F.col("first_date")
    stored = requests.join(windows.select("symbol", "first_date", "last_date"), "symbol", "left")
    head = first <= F.date_add("start", RANGE_TOLERANCE_DAYS)
    until = F.least(F.col("end"), F.date_sub(first, 1))
    action = F.when(first.isNull(), "full").when(head | (until < F.col("start")), "cached").otherwise("prefix")
    planned = stored.withColumn("action", action)
    fetches = F.col("action") != "cached"
    return planned.select(
        "symbol",
        "start",
        "end",
        "action",
        F.when(fetches, F.col("start")).alias("fetch_start"),
        F.when(F.col("action") == "full", F.col("end")).when(fetches, until).alias("fetch_end"),
        F.coalesce(~incomplete_range(first, F.col("last_date"), F.col("start"), F.col("end")), F.lit(False)).alias(
            "covers_range"
        ),
    )


def _minimum_bars(days: Column) -> Column:
    return F.when(days < 365, 0).otherwise(F.greatest(F.lit(252), F.floor(days / 2)))


def import_bars(
    parsed: DataFrame, existing: DataFrame, requests: DataFrame, strict: bool = True, from_cache: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(bars to append, one summary row per requested symbol).

    ``parsed`` has ``issues`` and a total order in (source, row_number). A symbol whose
    stored bars already cover its range is left alone. Counts are taken in one pass over
    the new rows, and the stored table is only read as a key set and per-symbol extents.
    """
    state, tagged = _tagged(parsed, existing, requests)
    return _fresh(tagged), _summary(state, tagged, strict, from_cache)


def store_import(
    parsed: DataFrame, existing: DataFrame, requests: DataFrame, path: str, strict: bool = True, from_cache: bool = False
) -> tuple[DataFrame, dict]:
    """Appends the new bars to the Parquet table at ``path``. Returns (one summary row per requested symbol, what was written).

    The incoming rows are read once, for both: they are folded to their stamps and written, and the bars and the summary
    come from that. What was written (bars, first_session, last_session) is observed in the pass that writes it.
    """
    state, tagged = _tagged(parsed, existing, requests)
    state, tagged = materialize(state, "import-state"), materialize(tagged, "import-stamps")
    seen = Observation("import")
    written = _fresh(tagged).observe(seen, F.count(F.lit(1)).alias("bars"), F.min("session").alias("first_session"), F.max("session").alias("last_session"))
    written.write.mode("append").parquet(path)
    return _summary(state, tagged, strict, from_cache), seen.get


def _is_new() -> Column:
    return (F.col("_copies") > 0) & F.col("_old").isNull()


def _fresh(tagged: DataFrame) -> DataFrame:
    return tagged.filter(_is_new()).select("symbol", "ts", "_row.*")


def _tagged(parsed: DataFrame, existing: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state of each requested symbol, incoming stamps with their counts and whether they are stored)."""
    spans = requests.select("symbol", "start", "end")
    inside = F.col("session").between(F.col("start"), F.col("end"))
    # Only the requested symbols and ranges of the stored table take part in anything below.
    held = existing.join(spans, "symbol").filter(inside)
    before = held.groupBy("symbol").agg(
        F.min("session").alias("old_first"), F.max("session").alias("old_last"), F.count(F.lit(1)).alias("old_bars")
    )
    state = spans.join(before, "symbol", "left").withColumn(
        "covered", ~incomplete_range(F.col("old_first"), F.col("old_last"), F.col("start"), F.col("end"))
    )
    todo = state.filter(~F.col("covered")).select("symbol", "start", "end")
    rows = parsed.join(todo, "symbol").filter(inside)
    # One pass over the new rows: each task folds its rows of a stamp before the shuffle. The order's columns are part of
    # the row, so the least row is the first one, and they are shuffled once and not beside it.
    valid = F.size("issues") == 0
    order = ("source", "row_number")
    payload = [c for c in parsed.columns if c not in ("symbol", "ts", "issues")]
    first = F.struct(*order, *(c for c in payload if c not in order))
    stamps = rows.groupBy("symbol", "ts").agg(
        F.min(F.when(valid, first)).alias("_row"),
        F.count_if(valid).alias("_copies"),
        F.count_if(~valid).alias("_invalid"),
    )
    stamps = stamps.withColumn("_row", F.struct(*(F.col(f"_row.{c}") for c in payload)))
    tagged = stamps.join(held.select("symbol", "ts", F.lit(True).alias("_old")), ["symbol", "ts"], "left")
    return state, tagged


def _summary(state: DataFrame, tagged: DataFrame, strict: bool, from_cache: bool) -> DataFrame:
    good, fresh = F.col("_copies") > 0, _is_new()
    moved = tagged.groupBy("symbol").agg(
        F.sum(F.col("_copies") + F.col("_invalid")).alias("rows_read"),
        F.sum("_invalid").alias("invalid_rows"),
        F.count_if(good).alias("unique_bars"),
        F.count_if(fresh).alias("rows_inserted"),
        (F.sum("_copies") - F.count_if(fresh)).alias("new_duplicates"),
        F.min(F.when(fresh, F.col("_row.session"))).alias("new_first"),
        F.max(F.when(fresh, F.col("_row.session"))).alias("new_last"),
    )
    joined = state.join(moved, "symbol", "left").fillna(
        0, ["old_bars", "rows_read", "invalid_rows", "unique_bars", "rows_inserted", "new_duplicates"]
    )
    kept = F.col("rows_inserted") > 0
    first = F.least(F.col("old_first"), F.when(kept, F.col("new_first")))
    last = F.greatest(F.col("old_last"), F.when(kept, F.col("new_last")))
    days = F.datediff("end", "start")
    joined = joined.withColumn("first_date", first).withColumn("last_date", last).withColumn(
        "bars_stored", F.col("old_bars") + F.col("rows_inserted")
    )
    cut = (days >= 365) & incomplete_range(F.col("first_date"), F.col("last_date"), F.col("start"), F.col("end"))
    few = (F.lit(strict)) & (F.col("bars_stored") < _minimum_bars(days))
    failed = few | (cut if strict else F.lit(False))
    warned = (F.col("invalid_rows") > 0) | (F.lit(False) if strict else cut)
    repeated = F.col("new_duplicates") > 0
    status = (
        F.when(F.col("covered"), "SUCCESS")
        .when(F.col("rows_read") == 0, "EMPTY")
        .when(F.col("unique_bars") == 0, "FAILED")
        .when(failed, "FAILED")
        .when(warned, "SUCCESS_WITH_WARNINGS")
        .when(repeated & (F.col("rows_inserted") == 0), "SUCCESS")
        .when(repeated, "SUCCESS_WITH_WARNINGS")
        .otherwise("SUCCESS")
    )
    origin = (
        F.when(F.col("covered"), "DATABASE")
        .when(F.col("rows_read") == 0, "EMPTY")
        .when(F.col("unique_bars") == 0, "FAILED")
        .otherwise("CACHED" if from_cache else "DOWNLOADED")
    )
    return joined.select(
        "symbol",
        "rows_read",
        "rows_inserted",
        F.when(F.col("covered"), F.col("old_bars")).otherwise(F.col("new_duplicates")).alias("duplicates"),
        "invalid_rows",
        "first_date",
        "last_date",
        "bars_stored",
        status.alias("status"),
        origin.alias("origin"),
    )


def import_report(summary: DataFrame) -> DataFrame:
    """One row of totals over the summaries of a batch."""
    def n(column: str, value: str) -> Column:
        return F.count_if(F.col(column) == value)

    return summary.agg(
        F.count(F.lit(1)).alias("symbols"),
        n("origin", "DOWNLOADED").alias("downloaded"),
        n("origin", "CACHED").alias("cached"),
        n("origin", "DATABASE").alias("already_stored"),
        n("status", "FAILED").alias("failed"),
        n("status", "EMPTY").alias("empty"),
        F.coalesce(F.sum("rows_inserted"), F.lit(0)).alias("rows_inserted"),
        F.coalesce(F.sum("duplicates"), F.lit(0)).alias("duplicates_skipped"),
    )
