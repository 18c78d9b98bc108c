"""Point-in-time universes, their changes and their checks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlab.functions.dates import day, effective_end, overlaps_window
from pitlab.operators.dedupe import upsert_new
from pitlab.operators.intervals import expand_to_dates, latest_end, overlap_counts


def universe_as_of(memberships: DataFrame, dates: DataFrame) -> DataFrame:
    """Members on each date with the interval that makes them one (the earliest, if several).

    A symbol's intervals are cut first, each to the days on which all earlier ones have ended: there it is the earliest. The
    stretches left do not overlap, so they open into dates without a shuffle or a sort of members by date.
    """
    # One row per symbol and different interval is ordered.
    distinct = memberships.select("symbol", "start_date", "end_date").distinct()
    earlier = Window.partitionBy("symbol").orderBy("start_date", "end_date").rowsBetween(Window.unboundedPreceding, -1)
    stop = effective_end(F.col("end_date"))
    cut = distinct.withColumn("_from", F.greatest(F.col("start_date"), F.max(stop).over(earlier)))
    # A NULL start is before every day.
    stretches = cut.filter(F.col("_from").isNull() | (F.col("_from") < stop))
    return expand_to_dates(stretches, dates.select("as_of"), start="_from").select("as_of", "symbol", "start_date", "end_date")


def current_universe(memberships: DataFrame, dates: DataFrame) -> DataFrame:
    """Today's members on every date, flagged as survivorship-biased."""
    now = memberships.filter(F.col("end_date").isNull()).select("symbol").distinct()
    always = now.select("symbol", day("0001-01-01").alias("start_date"), F.lit(None).cast("date").alias("end_date"))
    return expand_to_dates(always, dates.select("as_of")).select(
        "as_of", "symbol", F.lit(True).alias("survivorship_biased")
    )


def members_overlapping(memberships: DataFrame, start: date, end: date) -> DataFrame:
    return (
        memberships.filter(overlaps_window(F.col("start_date"), F.col("end_date"), start, end)).select("symbol").distinct()
    )


def universe_slice(universe: DataFrame, bars: DataFrame, unusable: DataFrame | None = None) -> DataFrame:
    """Each member on each date as priced, missing or unusable; nobody is dropped."""
    priced = bars.select("symbol").distinct().withColumn("_priced", F.lit(True))
    tagged = universe.select("as_of", "symbol").distinct().join(priced, "symbol", "left")
    bad = F.lit(False)
    if unusable is not None:
        tagged = tagged.join(unusable.select("symbol").distinct().withColumn("_bad", F.lit(True)), "symbol", "left")
        bad = F.col("_bad").isNotNull()
    state = F.when(F.col("_priced").isNull(), "missing").when(bad, "unusable").otherwise("priced")
    return tagged.select("as_of", "symbol", state.alias("state"))


def missing_members(universe: DataFrame, bars: DataFrame) -> DataFrame:
    return universe.select("as_of", "symbol").distinct().join(bars.select("symbol").distinct(), "symbol", "left_anti")


def _numbered(dates: DataFrame) -> DataFrame:
    return dates.select("as_of", F.row_number().over(Window.orderBy("as_of")).cast("long").alias("n"))


def universe_changes(
    memberships: DataFrame, dates: DataFrame, suspicious: DataFrame | None = None, changes_only: bool = False
) -> DataFrame:
    """Rows per date and symbol: joined, member or left_index, with ``;suspicious`` marks.

    On the first date everyone joins and nobody leaves.
    """
    numbered = F.broadcast(_numbered(dates))
    now = universe_as_of(memberships, dates).join(numbered, "as_of").drop("as_of")
    before = now.select((F.col("n") + 1).alias("n"), "symbol", F.lit(True).alias("_before"))
    both = now.withColumn("_now", F.lit(True)).join(before, ["n", "symbol"], "full_outer").join(numbered, "n")
    mark = F.lit("")
    if suspicious is not None:
        flagged = suspicious.select("symbol").distinct().withColumn("_sus", F.lit(True))
        both = both.join(flagged, "symbol", "left")
        mark = F.when(F.col("_sus").isNotNull(), ";suspicious").otherwise("")
    here, was = F.col("_now").isNotNull(), F.col("_before").isNotNull()
    base = F.when(was, "member").otherwise("joined")
    reason = F.when(~here, F.lit("left_index")).otherwise(F.concat(base, mark))
    rows = both.filter(~(here & was)) if changes_only else both
    return rows.select(
        F.col("as_of").alias("rebalance_date"),
        "symbol",
        here.alias("eligible"),
        F.col("start_date").alias("membership_start"),
        F.col("end_date").alias("membership_end"),
        reason.alias("eligibility_reason"),
    )


def universe_summary(memberships: DataFrame, dates: DataFrame, suspicious: DataFrame | None = None) -> DataFrame:
    """Size, joiners, leavers and suspicious names per date; dates without members are kept."""
    detail = universe_changes(memberships, dates, suspicious)
    reason = F.col("eligibility_reason")
    counted = detail.groupBy("rebalance_date").agg(
        F.count_if("eligible").alias("universe_size"),
        F.count_if(reason.startswith("joined")).alias("new_constituents"),
        F.count_if(reason == "left_index").alias("removed_constituents"),
        F.count_if(reason.endswith(";suspicious")).alias("suspicious_constituents"),
    )
    every = dates.select(F.col("as_of").alias("rebalance_date"))
    names = ["universe_size", "new_constituents", "removed_constituents", "suspicious_constituents"]
    return every.join(counted, "rebalance_date", "left").fillna(0, names).withColumn(
        "invalid_constituents", F.lit(0).cast("long")
    )


def encountered_symbols(memberships: DataFrame, dates: DataFrame) -> DataFrame:
    """Symbols that are members on at least one date."""
    return expand_to_dates(memberships.select("symbol", "start_date", "end_date"), dates.select("as_of")).select(
        "symbol"
    ).distinct()


def appearances(memberships: DataFrame, dates: DataFrame) -> DataFrame:
    """First and last date of membership and their number, per symbol."""
    return universe_as_of(memberships, dates).groupBy("symbol").agg(
        F.min("as_of").alias("first_appearance"),
        F.max("as_of").alias("last_appearance"),
        F.count(F.lit(1)).alias("appearances"),
    )


def universe_report(memberships: DataFrame, as_of: date) -> DataFrame:
    """One row of counts and extents as of a date, folded per symbol first."""
    here = (F.col("start_date") <= day(as_of)) & (F.col("end_date").isNull() | (day(as_of) < F.col("end_date")))
    per_symbol = memberships.groupBy("symbol").agg(
        F.bool_or(here).alias("member"),
        F.count(F.lit(1)).alias("intervals"),
        F.count_if(F.col("end_date").isNull()).alias("open_intervals"),
        F.bool_and(F.col("end_date").isNotNull()).alias("ended"),
        F.min("start_date").alias("first_start"),
        F.max("start_date").alias("last_start"),
        F.max("end_date").alias("last_end"),
    )
    total = F.coalesce(F.sum("intervals"), F.lit(0))
    return per_symbol.agg(
        F.count_if("member").alias("members"),
        F.min("first_start").alias("earliest_start"),
        F.max("last_start").alias("latest_start"),
        F.max("last_end").alias("latest_end"),
        total.alias("intervals"),
        total.alias("changes"),
        F.count_if(F.col("intervals") > 1).alias("multi_period_symbols"),
        F.coalesce(F.sum("open_intervals"), F.lit(0)).alias("active_members"),
        F.count_if("ended").alias("historical_only"),
    )


def future_leakage(selected: DataFrame, memberships: DataFrame) -> DataFrame:
    """Selected (as_of, symbol) whose only claim is an open interval that starts later."""
    picked = selected.select("as_of", "symbol").distinct()
    spans = memberships.select(F.col("symbol").alias("_s"), "start_date", "end_date")
    same = F.col("symbol") == F.col("_s")
    later = picked.join(
        spans, same & F.col("end_date").isNull() & (F.col("start_date") > F.col("as_of")), "left_semi"
    )
    valid = same & (F.col("start_date") <= F.col("as_of")) & (F.col("end_date").isNull() | (F.col("as_of") < F.col("end_date")))
    return later.join(spans, valid, "left_anti")


def validate_memberships(memberships: DataFrame) -> DataFrame:
    """Copies, overlaps and impossible ranges per distinct interval."""
    return overlap_counts(memberships, ["symbol"], "start_date", "end_date")


def persistable(memberships: DataFrame) -> tuple[DataFrame, bool]:
    """(distinct intervals, may they be stored?). Overlaps and impossible ranges block; copies do not."""
    checked = validate_memberships(memberships)
    blocking = not checked.filter(F.col("impossible") | (F.col("overlap_count") > 0)).isEmpty()
    return memberships.dropDuplicates(["symbol", "start_date", "end_date"]), not blocking


def upsert_memberships(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Intervals of ``incoming`` that are not stored; an open end equals an open end."""
    return upsert_new(stored, incoming, ["symbol", "start_date"], ["end_date"])


def persist_memberships(memberships: DataFrame, path: str, stored: DataFrame | None = None) -> bool:
    """Appends the intervals that are not ``stored`` to the Parquet table at ``path``, if all of them may be stored.

    Returns whether it wrote. An overlap or an impossible range blocks the whole write; copies are stored once.
    """
    rows, allowed = persistable(memberships)
    if allowed:
        (rows if stored is None else upsert_memberships(stored, rows)).write.mode("append").parquet(path)
    return allowed


def membership_extents(memberships: DataFrame) -> DataFrame:
    return memberships.groupBy("symbol").agg(
        F.min("start_date").alias("first_start"), latest_end("end_date").alias("latest_end")
    )


def cross_check(left: DataFrame, right: DataFrame, preview: int = 50) -> DataFrame:
    """Two universes compared per date: sizes, differences and the first names on each side.

    The previews come from ranks, so no list longer than ``preview`` is ever built.
    """
    a = left.select("as_of", "symbol").distinct().withColumn("_l", F.lit(True))
    b = right.select("as_of", "symbol").distinct().withColumn("_r", F.lit(True))
    both = a.join(b, ["as_of", "symbol"], "full_outer")
    only_left, only_right = F.col("_r").isNull(), F.col("_l").isNull()
    counts = both.groupBy("as_of").agg(
        F.count("_l").alias("left_count"),
        F.count("_r").alias("right_count"),
        F.count_if(only_left | only_right).alias("disagreements"),
    )
    side = F.when(only_left, "left").when(only_right, "right")
    apart = both.withColumn("_side", side).filter(F.col("_side").isNotNull())
    w = Window.partitionBy("as_of", "_side").orderBy("symbol")
    firsts = apart.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= preview)

    def names(which: str) -> Column:
        return F.array_join(F.array_sort(F.collect_list(F.when(F.col("_side") == which, F.col("symbol")))), ",")

    lists = firsts.groupBy("as_of").agg(names("left").alias("only_left"), names("right").alias("only_right"))
    return counts.join(lists, "as_of", "left").fillna("", ["only_left", "only_right"])


def resolve_universe(explicit: DataFrame | None, settings: DataFrame | None, files: DataFrame | None) -> DataFrame:
    """The symbols of the strongest source that names any: explicit, then settings, then files."""
    ranked = [
        df.select(F.upper(F.trim("symbol")).alias("symbol"), F.lit(i).alias("precedence"))
        for i, df in enumerate((explicit, settings, files))
        if df is not None
    ]
    if not ranked:
        raise ValueError("no source names a universe")
    together = ranked[0]
    for other in ranked[1:]:
        together = together.unionByName(other)
    named = together.filter(F.col("symbol") != "")
    return named.filter(F.col("precedence") == named.agg(F.min("precedence")).scalar()).select("symbol").distinct()


def available_symbols(settings: DataFrame, files: DataFrame) -> DataFrame:
    return settings.select(F.upper(F.trim("symbol")).alias("symbol")).union(files.select("symbol")).distinct().orderBy("symbol")
