"""Mapping index occupancies to vendor assets, and the gates that a vendor must pass."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlab.operators.rows import side_by_side
from pitlab.functions.checks import breaks, strict_bar_rules
from pitlab.functions.dates import day, effective_end, midpoint, overlaps_window, valid_at
from pitlab.functions.text import REMOVAL_SUFFIX, is_alias_identity, provisional_seed_key
from pitlab.operators.identity import resolve_security
from pitlab.plans.quality import VENDOR_GAP_DAYS, bar_gaps

PASS, FAIL, PARTIAL, NOT_TESTABLE = "PASS", "FAIL", "PARTIAL", "NOT_TESTABLE"
MAPPED, UNRESOLVED, CONFLICT = "MAPPED", "UNRESOLVED", "CONFLICT"


@dataclass(frozen=True)
class EvalWindow:
    """Days on which vendor series are judged, both included."""

    start: date
    end: date


def build_occupancies(
    memberships: DataFrame, securities: DataFrame, tickers: DataFrame, start: date, end: date, overlay: DataFrame | None = None
) -> DataFrame:
    """Index intervals that touch the window, and overlay rows, one per (ticker, start, end).

    Identity is taken at the middle of an interval (its start, while it is open); overlays
    at their start. Without one the occupancy gets a provisional key.
    """
    inside = memberships.filter(overlaps_window(F.col("start_date"), F.col("end_date"), start, end))
    asked = F.when(F.col("end_date").isNull(), F.col("start_date")).otherwise(midpoint(F.col("start_date"), F.col("end_date"), end))
    own = inside.select(
        F.col("symbol").alias("ticker"), "start_date", "end_date", asked.alias("asked"), F.lit(None).cast("string").alias("given_seed"), F.lit(False).alias("overlay")
    )
    rows = own
    if overlay is not None:
        rows = own.unionByName(
            overlay.select(
                "ticker", "start_date", "end_date", F.col("start_date").alias("asked"), F.col("seed_key").alias("given_seed"), F.lit(True).alias("overlay")
            )
        )
    # An index interval wins over an overlay of the same ticker and days.
    single = rows.groupBy("ticker", "start_date", "end_date").agg(
        F.min_by(F.struct("asked", "given_seed", "overlay"), F.struct("overlay", "given_seed")).alias("_r")
    ).select("ticker", "start_date", "end_date", "_r.*")
    found = resolve_security(single, tickers, "ticker", "asked")
    named = found.join(securities.select("seed_key", "display_name"), "seed_key", "left")
    fallback = provisional_seed_key(F.col("ticker"), F.col("start_date"), F.col("end_date"))
    return named.select(
        "ticker", "start_date", "end_date",
        F.coalesce("display_name", F.lit("")).alias("expected_identity"),
        F.coalesce("seed_key", "given_seed", fallback).alias("seed_key"),
        "overlay",
    )


def eval_bounds(w: EvalWindow) -> tuple[Column, Column]:
    """First and last judged day of an occupancy row, both included."""
    last = F.when(F.col("end_date").isNull(), day(w.end)).otherwise(F.least(day(w.end), F.date_sub("end_date", 1)))
    return F.greatest(day(w.start), F.col("start_date")), last


def delisted_suffixes(vendor: DataFrame) -> DataFrame:
    """(ticker, suffix_symbol): vendor symbols ``TICKER-YYYYMM`` under their stem."""
    rows = vendor.filter(F.col("vendor_symbol").rlike("^.+" + REMOVAL_SUFFIX))
    return rows.select(
        F.regexp_replace("vendor_symbol", REMOVAL_SUFFIX, "").alias("ticker"), F.col("vendor_symbol").alias("suffix_symbol")
    ).distinct()


def may_use_current_ticker(occupancies: DataFrame, tickers: DataFrame, w: EvalWindow) -> DataFrame:
    """Adds ``may_use_current``: the ticker names the same security then and at the end.

    Without an identity then, only an open occupancy may use the live ticker.
    """
    dated = occupancies.withColumn("_mid", midpoint(F.col("start_date"), F.col("end_date"), w.end)).withColumn("_end", day(w.end))
    then = resolve_security(dated, tickers, "ticker", "_mid", prefix="_then_")
    both = resolve_security(then, tickers, "ticker", "_end", prefix="_now_")
    verdict = (
        F.when(F.col("_then_seed_key").isNull(), F.col("end_date").isNull())
        .when(F.col("_now_seed_key").isNull(), F.lit(False))
        .otherwise(F.col("_then_seed_key") == F.col("_now_seed_key"))
    )
    return both.withColumn("may_use_current", verdict).select(*occupancies.columns, "may_use_current")


def map_occupancies(
    occupancies: DataFrame,
    vendor: DataFrame,
    tickers: DataFrame,
    w: EvalWindow,
    frozen: DataFrame | None = None,
    successors: DataFrame | None = None,
) -> DataFrame:
    """Vendor asset of each occupancy, never through a live ticker that now means another security.

    Candidates in order: the current ticker (if it still names the occupancy), a frozen
    suffix, discovered suffixes, the successor ticker. All but the first must have quotes
    that overlap the occupancy. The best candidate wins; if those that overlap name more
    than one asset, the occupancy is a CONFLICT.
    """
    keyed = may_use_current_ticker(occupancies, tickers, w)
    keys = ["ticker", "start_date", "end_date"]
    occ = keyed.withColumn("_end", effective_end(F.col("end_date")))
    base = occ.select("ticker", "start_date", "_end", "end_date", "may_use_current")
    current = base.filter("may_use_current").withColumn("candidate", F.col("ticker")).withColumn("priority", F.lit(0)).withColumn("source", F.lit("current_ticker"))
    sets = [current]

    def add(pairs: DataFrame, priority: int, source: str) -> None:
        sets.append(
            base.join(pairs, "ticker").withColumn("priority", F.lit(priority)).withColumn("source", F.lit(source))
        )

    if frozen is not None:
        # A frozen suffix may name one occupancy by its end, or every one of the ticker.
        exact = frozen.filter("valid_to is not null").select("ticker", F.col("valid_to").alias("_end"), F.col("suffix_symbol").alias("candidate"))
        sets.append(
            base.join(exact, ["ticker", "_end"]).withColumn("priority", F.lit(1)).withColumn("source", F.lit("frozen_suffix"))
        )
        add(frozen.groupBy("ticker").agg(F.max("suffix_symbol").alias("candidate")), 2, "frozen_suffix")
    add(delisted_suffixes(vendor).select("ticker", F.col("suffix_symbol").alias("candidate")), 3, "delisted_suffix")
    if successors is not None:
        add(successors.select(F.col("predecessor").alias("ticker"), F.col("successor").alias("candidate")), 4, "successor_ticker")
    names = ["ticker", "start_date", "_end", "end_date", "may_use_current", "candidate", "priority", "source"]
    candidates = reduce(lambda a, b: a.unionByName(b), [s.select(*names) for s in sets])
    found = candidates.join(vendor.withColumnRenamed("vendor_symbol", "candidate"), "candidate")
    first, last = eval_bounds(w)
    touches = (first <= last) & (F.col("first_quoted") <= last) & (F.coalesce("last_quoted", day(w.end)) >= first)
    usable = found.filter((F.col("priority") == 0) | touches)
    hit = F.struct("candidate", "asset_id", "security_name", "first_quoted", "last_quoted", "source")
    best = usable.groupBy("ticker", "start_date", "_end").agg(
        F.min_by(hit, F.struct("priority", "candidate")).alias("_hit"),
        F.min("priority").alias("_priority"),
        F.count_distinct(F.when(F.col("priority") > 0, F.col("asset_id"))).alias("_assets"),
    )
    live = vendor.select(F.col("vendor_symbol").alias("ticker"), F.col("asset_id").alias("current_ticker_asset_id"))
    joined = occ.join(best, ["ticker", "start_date", "_end"], "left").join(live, "ticker", "left")
    status = (
        F.when(F.col("_hit").isNull(), UNRESOLVED)
        .when((F.col("_priority") > 0) & (F.col("_assets") > 1), CONFLICT)
        .otherwise(MAPPED)
    )
    extra = [c for c in occupancies.columns if c not in keys]
    return joined.select(
        *keys, *extra,
        F.col("_hit.candidate").alias("vendor_symbol"),
        F.col("_hit.asset_id").alias("asset_id"),
        F.col("_hit.security_name").alias("security_name"),
        F.col("_hit.first_quoted").alias("first_quoted"),
        F.col("_hit.last_quoted").alias("last_quoted"),
        F.coalesce("_hit.source", F.lit("")).alias("identity_source"),
        status.alias("mapping_status"),
        "current_ticker_asset_id",
        "may_use_current",
        ((F.coalesce("_hit.source", F.lit("")) == "current_ticker") & ~F.col("may_use_current")).alias("contaminated"),
    )


def occupancy_at(mappings: DataFrame, asked: DataFrame) -> DataFrame:
    """(ticker, as_of) with the asset of the one occupancy that holds the day, else NULL."""
    left, right = asked.select("ticker", "as_of").distinct().alias("a"), mappings.alias("m")
    inside = (F.col("a.ticker") == F.col("m.ticker")) & valid_at(F.col("m.start_date"), F.col("m.end_date"), F.col("a.as_of"))
    return left.join(right, inside, "left").groupBy(F.col("a.ticker").alias("ticker"), F.col("a.as_of").alias("as_of")).agg(
        F.count("m.ticker").alias("matches"),
        F.when(F.count("m.ticker") == 1, F.min("m.asset_id")).alias("asset_id"),
        F.coalesce(F.bool_or("m.contaminated"), F.lit(False)).alias("contaminated"),
    )


def window_ticker_count(occupancies: DataFrame, start: date, end: date) -> DataFrame:
    inside = ~F.col("overlay") & overlaps_window(F.col("start_date"), F.col("end_date"), start, end)
    return occupancies.filter(inside).agg(F.count_distinct("ticker").alias("window_tickers"))


def clip_to_occupancy(bars: DataFrame, occupancies: DataFrame, w: EvalWindow, key: str = "ticker") -> DataFrame:
    """Bars inside the judged days of their occupancy."""
    first, last = eval_bounds(w)
    spans = occupancies.select(
        F.col(key).alias("_key"), "start_date", "end_date", first.alias("_first"), last.alias("_last")
    )
    cond = (F.col("symbol") == F.col("_key")) & F.col("session").between(F.col("_first"), F.col("_last"))
    return bars.join(spans, cond).drop("_key", "_first", "_last")


def series_cover(mappings: DataFrame, windows: DataFrame, w: EvalWindow) -> DataFrame:
    """Whether the series of each judged occupancy starts and ends where it should.

    ``windows``: asset_id, first_date, last_date. A tape may end at its last quote.
    """
    first, last = eval_bounds(w)
    judged = mappings.withColumn("eval_start", first).withColumn("eval_end", last).filter("eval_start <= eval_end")
    joined = judged.join(windows.select("asset_id", "first_date", "last_date"), "asset_id", "left")
    expected = F.least("eval_end", F.coalesce("last_quoted", "eval_end"))
    covers = (F.col("first_date") <= F.col("eval_start")) & (F.col("last_date") >= expected)
    return joined.withColumn("covers", F.coalesce(covers, F.lit(False))).withColumn("has_series", F.col("first_date").isNotNull())


def adjustment_differs(adjusted: DataFrame, raw: DataFrame) -> DataFrame:
    """Per symbol: do adjusted and raw closes differ on any shared day? NULL without a shared day."""
    none = F.lit(None).cast(raw.schema["close"].dataType)
    a = adjusted.select("symbol", "session", F.coalesce("adjusted_close", "close").alias("_a"), none.alias("_b"))
    b = raw.select("symbol", "session", none.alias("_a"), F.col("close").alias("_b"))
    # No pair of a day differs if the greatest of one side is the least of the other, both ways. A NULL price or day compares with nothing.
    ends = [f(c).alias(f"{n}{c}") for c in ("_a", "_b") for n, f in (("_least", F.min), ("_most", F.max))]
    daily = a.unionByName(b).groupBy("symbol", "session").agg(*ends)
    apart = (F.col("_least_a") != F.col("_most_b")) | (F.col("_most_a") != F.col("_least_b"))
    shared = F.col("symbol").isNotNull() & F.col("session").isNotNull()
    return daily.groupBy("symbol").agg(F.bool_or(F.when(shared, apart)).alias("differs"))


def compare_renames(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rename pairs should share an asset.

    ``rows``: ticker, asset_ids ARRAY<STRING> (empty strings already gone). Shared PASS,
    disjoint FAIL, no predecessor asset PARTIAL, no successor asset or a missing row NOT_TESTABLE.
    """
    old = rows.select(F.col("ticker").alias("predecessor"), F.col("asset_ids").alias("_old"))
    new = rows.select(F.col("ticker").alias("successor"), F.col("asset_ids").alias("_new"))
    joined = pairs.join(old, "predecessor", "left").join(new, "successor", "left")
    status = (
        F.when(F.col("_old").isNull() | F.col("_new").isNull() | (F.size("_new") == 0), NOT_TESTABLE)
        .when(F.size("_old") == 0, PARTIAL)
        .when(F.arrays_overlap("_old", "_new"), PASS)
        .otherwise(FAIL)
    )
    return joined.select("predecessor", "successor", status.alias("status"))


def compare_recycled(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Recycled pairs (first, second) of row ids must have different assets."""
    a = rows.select(F.col("row_id").alias("first"), F.col("asset_id").alias("_a"))
    b = rows.select(F.col("row_id").alias("second"), F.col("asset_id").alias("_b"))
    joined = pairs.join(a, "first", "left").join(b, "second", "left")
    status = (
        F.when(F.col("_a").isNull() & F.col("_b").isNull(), NOT_TESTABLE)
        .when(F.col("_a").isNull() | F.col("_b").isNull(), PARTIAL)
        .when(F.col("_a") == F.col("_b"), FAIL)
        .otherwise(PASS)
    )
    return joined.select("first", "second", status.alias("status"))


def coverage_status(w: EvalWindow) -> Column:
    """Quotes against the part of the window in which the security existed.

    Outside the window only quotes over the whole window prove anything.
    """
    first, last = F.col("first_quoted"), F.coalesce("last_quoted", day(w.end))
    begin = F.greatest(day(w.start), F.coalesce("valid_from", day(w.start)))
    finish = F.least(day(w.end), F.coalesce("valid_to", day(w.end)))
    whole = (first <= day(w.start)) & (last >= day(w.end))
    return (
        F.when(first.isNull(), NOT_TESTABLE)
        .when(begin > finish, F.when(whole, PASS).otherwise(NOT_TESTABLE))
        .when((first <= begin) & (last >= finish), PASS)
        .otherwise(FAIL)
    )


def sample_verdicts(samples: DataFrame, vendor: DataFrame, w: EvalWindow) -> DataFrame:
    """Identity, coverage and verdict of named samples.

    ``samples``: ticker, valid_from, valid_to, must_not_alias, frozen_suffix (NULL for a
    listing that should still trade). With a suffix, the frozen symbol comes first, then a
    discovered one, and the current ticker never counts.
    """
    def looked_up(name: str) -> DataFrame:
        return vendor.select(
            F.col("vendor_symbol").alias(f"_{name}_symbol"),
            F.struct("vendor_symbol", "asset_id", "security_name", "first_quoted", "last_quoted").alias(f"_{name}"),
        )

    # The first discovered suffix per ticker; a stem has one row per listing that ended.
    discovered = delisted_suffixes(vendor).groupBy("ticker").agg(F.min("suffix_symbol").alias("_found_symbol"))
    rows = (
        samples.withColumn("_now_symbol", F.col("ticker"))
        .withColumn("_frozen_symbol", F.col("frozen_suffix"))
        .join(discovered, "ticker", "left")
        .join(looked_up("now"), "_now_symbol", "left")
        .join(looked_up("frozen"), "_frozen_symbol", "left")
        .join(looked_up("found"), "_found_symbol", "left")
    )
    ended = F.col("frozen_suffix").isNotNull()
    pick = F.when(ended, F.coalesce("_frozen", "_found")).otherwise(F.col("_now"))
    source = (
        F.when(pick.isNull(), "")
        .when(~ended, "current_ticker")
        .when(F.col("_frozen").isNotNull(), "frozen_suffix")
        .otherwise("discovered_suffix")
    )
    rows = rows.withColumn("_pick", pick).withColumn("identity_source", source).select(
        *samples.columns, "identity_source", "_pick.*", F.col("_pick").isNotNull().alias("_has"),
        F.col("_now.asset_id").alias("current_asset_id"), F.col("_frozen.asset_id").alias("delisted_asset_id"),
    )
    alias = is_alias_identity(F.col("vendor_symbol"), F.col("security_name"), F.col("must_not_alias"))
    rows = rows.withColumn("identity_status", F.when(~F.col("_has"), NOT_TESTABLE).when(alias, FAIL).otherwise(PASS))
    rows = rows.withColumn("coverage_status", F.when(~F.col("_has"), NOT_TESTABLE).otherwise(coverage_status(w)))
    both = [F.col("identity_status"), F.col("coverage_status")]
    verdict = (
        F.when((both[0] == FAIL) | (both[1] == FAIL), FAIL)
        .when((both[0] == PASS) & (both[1] == PASS), PASS)
        .otherwise(NOT_TESTABLE)
    )
    return rows.withColumn("verdict", verdict).drop("_has")


def _gates(df: DataFrame, *gates: tuple[str, Column, Column]) -> DataFrame:
    """A row per gate (name, status, n) from the one row of ``df``, which is computed once for all of them."""
    rows = [F.struct(F.lit(name).alias("gate"), status.alias("status"), n.cast("long").alias("n")) for name, status, n in gates]
    return df.select(F.inline(F.array(*rows)))


def _gate(name: str, df: DataFrame, status: Column, n: Column) -> DataFrame:
    return df.select(F.lit(name).alias("gate"), status.alias("status"), n.cast("long").alias("n"))


def sample_gates(samples: DataFrame) -> DataFrame:
    """F1 no identity failure; F2 no coverage failure and some in-window proof. n counts failures."""
    s = samples.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("identity_status") == FAIL).alias("id_fail"),
        F.count_if(F.col("coverage_status") == FAIL).alias("cov_fail"),
        F.count_if(F.col("coverage_status") == PASS).alias("cov_pass"),
    )
    f1 = F.when(F.col("rows") == 0, NOT_TESTABLE).when(F.col("id_fail") > 0, FAIL).otherwise(PASS)
    f2 = (
        F.when(F.col("rows") == 0, NOT_TESTABLE)
        .when(F.col("cov_fail") > 0, FAIL)
        .when(F.col("cov_pass") == 0, NOT_TESTABLE)
        .otherwise(PASS)
    )
    return _gates(s, ("F1", f1, F.col("id_fail")), ("F2", f2, F.col("cov_fail")))


def pair_gate(name: str, pairs: DataFrame) -> DataFrame:
    """F3 (renames) and F4 (must differ): FAIL if any pair fails, PASS if all pass, else PARTIAL."""
    s = pairs.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("status") == FAIL).alias("bad"),
        F.count_if(F.col("status") == PASS).alias("good"),
        F.count_if(F.col("status") == NOT_TESTABLE).alias("untested"),
    )
    none = F.col("rows") == 0
    if name == "F4":
        none = none | (F.col("untested") == F.col("rows"))
    status = F.when(none, NOT_TESTABLE).when(F.col("bad") > 0, FAIL).when(F.col("good") == F.col("rows"), PASS).otherwise(PARTIAL)
    return _gate(name, s, status, F.col("bad"))


def occupancy_gates(
    mappings: DataFrame, bars: DataFrame, asked: DataFrame, start: date, end: date, w: EvalWindow, expected_tickers: int = 0
) -> DataFrame:
    """U1 no live-ticker contamination and all window tickers tried; U2 series cover their
    occupancy without interior gaps; J1 every member has an occupancy on each asked date.

    ``bars``: asset_id, session. ``asked``: ticker, as_of.
    """
    tried = F.count_distinct(
        F.when(~F.col("overlay") & overlaps_window(F.col("start_date"), F.col("end_date"), start, end), F.col("ticker"))
    )
    s1 = mappings.agg(F.count(F.lit(1)).alias("rows"), F.count_if("contaminated").alias("bad"), tried.alias("tried"))
    u1 = (
        F.when(F.col("rows") == 0, NOT_TESTABLE)
        .when(F.col("bad") > 0, FAIL)
        .when(F.lit(expected_tickers) > F.col("tried"), FAIL)
        .otherwise(PASS)
    )
    windows = bars.groupBy("asset_id").agg(F.min("session").alias("first_date"), F.max("session").alias("last_date"))
    gaps = bar_gaps(bars.select(F.col("asset_id").alias("symbol"), "session"), VENDOR_GAP_DAYS)
    gapped = gaps.select(F.col("symbol").alias("asset_id")).distinct().withColumn("_gap", F.lit(True))
    covered = series_cover(mappings.filter(F.col("mapping_status") == MAPPED), windows, w).join(gapped, "asset_id", "left")
    short = F.col("has_series") & (F.col("_gap").isNotNull() | ~F.col("covers"))
    s2 = covered.agg(F.count(F.lit(1)).alias("rows"), F.count_if(short).alias("bad"))
    u2 = F.when(F.col("bad") > 0, FAIL).otherwise(PASS)
    at = occupancy_at(mappings, asked)
    s3 = at.agg(F.count(F.lit(1)).alias("rows"), F.count_if((F.col("matches") == 0) | F.col("contaminated")).alias("bad"))
    j1 = F.when(F.col("rows") == 0, NOT_TESTABLE).when(F.col("bad") > 0, FAIL).otherwise(PASS)
    return (
        _gate("U1", s1, u1, F.col("bad"))
        .unionByName(_gate("U2", s2, u2, F.col("bad")))
        .unionByName(_gate("J1", s3, j1, F.col("bad")))
    )


def series_gates(adjusted: DataFrame, raw: DataFrame) -> DataFrame:
    """A1 both series exist and adjusted bars are clean; A2 adjustment shows; Q1 strict bar rules hold."""
    bad = breaks(strict_bar_rules())
    clean = adjusted.agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("bad"))
    both = side_by_side(clean, raw.agg(F.count(F.lit(1)).alias("raw_rows")))
    a1 = F.when((F.col("rows") == 0) | (F.col("raw_rows") == 0), FAIL).when(F.col("bad") > 0, FAIL).otherwise(PASS)
    q1 = F.when(F.col("bad") > 0, FAIL).otherwise(PASS)
    differ = adjustment_differs(adjusted, raw).agg(
        F.count("differs").alias("known"), F.count_if("differs").alias("n")
    )
    a2 = F.when(F.col("known") == 0, NOT_TESTABLE).when(F.col("n") > 0, PASS).otherwise(PARTIAL)
    return _gates(both, ("A1", a1, F.col("bad")), ("Q1", q1, F.col("bad"))).unionByName(_gate("A2", differ, a2, F.col("n")))


def membership_gate(cross_checked: DataFrame | None) -> DataFrame | None:
    """M1: a comparison with a second source exists. n counts disagreements."""
    if cross_checked is None:
        return None
    s = cross_checked.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("disagreements"), F.lit(0)).alias("n"))
    return _gate("M1", s, F.when(F.col("rows") == 0, NOT_TESTABLE).otherwise(PASS), F.col("n"))
