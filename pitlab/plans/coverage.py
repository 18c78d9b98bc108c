"""Coverage of index membership by stored prices, with a reason for every shortfall."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlab.functions.dates import day, overlap_days, overlaps_window, valid_at
from pitlab.functions.text import format_interval
from pitlab.operators.calendars import month_starts
from pitlab.operators.identity import LISTING, VENDOR, resolve_security, ticker_history, vendor_symbols
from pitlab.operators.intervals import latest_end
from pitlab.plans.universe import encountered_symbols

# Verdict names of the coverage report.
REASONS = {
    "A": "A_unavailable",
    "B": "B_ticker_change",
    "C": "C_ticker_recycled",
    "D": "D_unresolved_identity",
    "E": "E_vendor_symbol_differs",
    "F": "F_delisted",
    "G": "G_data_under_other_ticker",
    "H": "H_identity_validation_failed",
    "I": "I_insufficient_evidence",
}
#: What a reason means, for readers of the report.
NOTES = {
    "": "prices cover membership",
    REASONS["A"]: "an ended listing without prices",
    REASONS["B"]: "renamed, and no prices under the new name",
    REASONS["C"]: "the name meant another security",
    REASONS["D"]: "not in the catalog",
    REASONS["E"]: "the vendor may write the name in another way",
    REASONS["F"]: "an ended listing with prices",
    REASONS["G"]: "prices are under another name",
    REASONS["H"]: "the series is another security's",
    REASONS["I"]: "too few prices to say more",
}


def pit_coverage(
    memberships: DataFrame,
    windows: DataFrame,
    securities: DataFrame,
    tickers: DataFrame,
    start: date,
    end: date,
    encounter_start: date | None = None,
    vendor_scheme: str = VENDOR,
) -> DataFrame:
    """One row per symbol that was a member in [start, end]. ``vendor_scheme`` marks the catalog's vendor tickers.

    Membership is folded to a row per symbol first; everything after that is an equi-join
    of per-symbol tables.
    """
    past_end = day(end + timedelta(days=1))
    spans = memberships.filter(overlaps_window(F.col("start_date"), F.col("end_date"), start, end))
    lo = F.greatest("start_date", day(start))
    hi = F.least(F.coalesce("end_date", past_end), past_end)
    text = F.struct(F.col("start_date").alias("s"), format_interval(F.col("start_date"), F.col("end_date")).alias("t"))
    # Distinct intervals of one symbol: bounded by the calendar.
    folded = spans.select("symbol", "start_date", "end_date").distinct().groupBy("symbol").agg(
        F.min("start_date").alias("pit_start"),
        latest_end("end_date").alias("pit_end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(text)), lambda x: x["t"]), "; ").alias("pit_intervals"),
        F.min(F.when(lo < hi, lo)).alias("_lo"),
        F.max(F.when(lo < hi, hi)).alias("_hi"),
    )
    rows = folded.select(
        "symbol", "pit_start", "pit_end", "pit_intervals",
        F.coalesce("_lo", day(start)).alias("expected_start"),
        F.coalesce("_hi", day(start)).alias("expected_end"),
    )

    names = vendor_symbols(
        rows.select(F.col("symbol").alias("listing"), F.col("expected_start").alias("w_start"), day(end).alias("w_end")), tickers, vendor_scheme
    )
    fetch = F.col("fetch_symbols")
    looked_up = F.when(F.size(fetch) > 1, F.slice(fetch, F.lit(2), F.size(fetch) - 1)).otherwise(fetch)
    win = windows.select(F.col("symbol").alias("_name"), F.struct("first_date", "last_date").alias("_w"))
    series = (
        names.select(F.col("listing").alias("symbol"), F.posexplode(looked_up).alias("_n", "_name"))
        .join(win, "_name")
        .groupBy("symbol")
        .agg(F.min_by("_w", "_n").alias("_found"))
    )
    preferred = names.select(F.col("listing").alias("symbol"), F.col("preferred_symbol").alias("vendor_symbol"))
    own = windows.select("symbol", F.struct("first_date", "last_date").alias("own"))
    rows = (
        rows.join(preferred, "symbol")
        .join(series, "symbol", "left")
        .join(own, "symbol", "left")
        .withColumn("series", F.coalesce("_found", "own"))
        .drop("_found")
    )

    rows = resolve_security(rows, tickers, "symbol", "expected_start", LISTING)
    rows = rows.withColumnRenamed("status", "identity_status")
    rows = resolve_security(rows, tickers, "vendor_symbol", "expected_start", vendor_scheme, "vendor_")
    rows = rows.withColumn("price_start", F.col("series.first_date")).withColumn("price_end", F.col("series.last_date"))
    rows = resolve_security(rows, tickers, "vendor_symbol", "price_start", vendor_scheme, "first_")
    rows = rows.join(securities.select("seed_key", F.col("status").alias("listing_status")), "seed_key", "left")

    recycled, renamed = ticker_history(tickers, start, end)
    rows = rows.join(recycled.select(F.col("ticker").alias("symbol"), F.lit(True).alias("_rec")), "symbol", "left")
    rows = rows.join(renamed.select("seed_key", F.lit(True).alias("_ren")), "seed_key", "left")

    catalog = tickers if "ord" in tickers.columns else tickers.withColumn("ord", F.lit(0))
    validity = (
        catalog.filter(F.col("scheme") == vendor_scheme)
        .groupBy(F.col("ticker").alias("vendor_symbol"), "seed_key")
        .agg(F.min_by(F.struct("valid_from", "valid_to"), F.struct("ord", "valid_from")).alias("_valid"))
    )
    rows = rows.join(validity, ["vendor_symbol", "seed_key"], "left")

    def touches(window: Column) -> Column:
        return window.isNotNull() & (window["first_date"] < F.col("expected_end")) & (
            F.date_add(window["last_date"], 1) > F.col("expected_start")
        )

    resolved = F.col("identity_status") == "RESOLVED"
    failed = resolved & (F.col("vendor_status") != "RESOLVED") & touches(F.col("own"))
    from_day = F.when(F.col("_valid").isNotNull(), F.greatest("price_start", F.col("_valid.valid_from"))).otherwise(F.col("price_start"))
    closes = F.date_add("price_end", 1)
    to_day = F.when(
        F.col("_valid").isNotNull(), F.least(closes, F.coalesce(F.col("_valid.valid_to"), closes))
    ).otherwise(closes)
    foreign = resolved & F.col("_valid").isNull() & (F.col("first_status") != "RESOLVED")
    shared = F.when(
        F.col("series").isNull() | F.col("failed") | foreign, 0
    ).otherwise(overlap_days(from_day, to_day, F.col("expected_start"), F.col("expected_end")))
    rows = (
        rows.withColumn("failed", failed)
        .withColumn("expected_days", F.greatest(F.datediff("expected_end", "expected_start"), F.lit(0)))
        .withColumn("coverage_days", shared)
        .withColumn("coverage_ratio", F.coalesce(F.try_divide(F.col("coverage_days").cast("double"), F.col("expected_days").cast("double")), F.lit(0.0)))
        .withColumn("_own_touches", touches(F.col("own")))
        .withColumn("_verdict", _verdict())
    )
    first = max(start, encounter_start) if encounter_start else start
    met = encountered_symbols(memberships, month_starts(memberships.sparkSession, first, end)).withColumn("_met", F.lit(True))
    return rows.join(met, "symbol", "left").select(
        "seed_key",
        F.col("symbol").alias("historical_ticker"),
        "pit_start",
        "pit_end",
        "pit_intervals",
        "identity_status",
        F.col("_verdict.market").alias("market_data_status"),
        "vendor_symbol",
        "price_start",
        "price_end",
        F.col("coverage_days").cast("long").alias("coverage_days"),
        F.col("expected_days").cast("long").alias("expected_days"),
        "coverage_ratio",
        F.col("_verdict.quality").alias("quality_status"),
        F.col("_verdict.reason").alias("reason"),
        F.col("_verdict.confidence").alias("confidence"),
        F.col("_met").isNotNull().alias("rebalance_encountered"),
        F.col("own").isNotNull().alias("local_listing"),
        F.create_map(*[F.lit(x) for pair in NOTES.items() for x in pair])[F.col("_verdict.reason")].alias("notes"),
    )


def _verdict() -> Column:
    """(quality, market, reason, confidence): the first rule that applies.

    A price-quality rule could also mark a series unusable; none exists, so only failed
    identity does.
    """
    c = F.col
    resolved = c("identity_status") == "RESOLVED"
    other = c("vendor_symbol") != c("symbol")
    some, none = c("coverage_days") > 0, c("coverage_days") <= 0
    whole = c("coverage_ratio") >= 1
    delisted = F.coalesce(c("listing_status") == "DELISTED", F.lit(False))
    dotted = c("symbol").contains(".")
    local = c("own").isNotNull()

    def out(quality: Column | str, market: Column | str, reason: Column | str, confidence: Column | str) -> Column:
        parts = {"quality": quality, "market": market, "reason": reason, "confidence": confidence}
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in parts.items()])

    def pick(cond: Column, yes: str, no: str) -> Column:
        return F.when(cond, yes).otherwise(no)

    sure_or = lambda no: pick(resolved, "high", no)
    covered_quality = pick(whole, "valid", "partial")
    na = "not_applicable"
    missing = lambda reason, confidence: out(na, "missing", reason, confidence)
    return (
        F.when(c("failed"), out("unusable", "unusable", REASONS["H"], sure_or("medium")))
        .when(c("_rec").isNotNull() & none, out(pick(c("_own_touches"), "unusable", na), "missing", REASONS["C"], "high"))
        .when(other & c("series").isNotNull() & some, out(covered_quality, pick(whole, "available_other_ticker", "partial"), REASONS["G"], "high"))
        .when(other & c("series").isNull(), missing(pick(dotted, REASONS["E"], REASONS["B"]), sure_or("medium")))
        .when(c("_ren").isNotNull() & none, missing(REASONS["B"], sure_or("low")))
        .when(delisted & some, out(covered_quality, pick(whole, "available", "partial"), REASONS["F"], "high"))
        .when(delisted & local & (c("own.first_date") >= c("expected_end")), missing(REASONS["C"], "high"))
        .when(delisted, missing(pick(resolved, REASONS["A"], REASONS["D"]), sure_or("low")))
        .when(none & ~local & ~resolved, missing(pick(dotted, REASONS["E"], REASONS["D"]), pick(dotted, "medium", "low")))
        .when(none, missing(pick(resolved, REASONS["I"], REASONS["D"]), "low"))
        .when(c("coverage_ratio") < 1, out("partial", "partial", pick(resolved, REASONS["I"], REASONS["D"]), pick(resolved, "medium", "low")))
        .otherwise(out("valid", "available", pick(resolved, "", REASONS["D"]), sure_or("low")))
    )


def prove_samples(samples: DataFrame, memberships: DataFrame, tickers: DataFrame, windows: DataFrame) -> DataFrame:
    """Each (ticker, as_of) with its index interval, its security and whether prices reach that day.

    ``proof`` is PASS if all three are there, else the first that is missing: no_membership, no_identity or no_prices. A day
    inside two intervals has the one that began first.
    """
    asked = samples.select("ticker", "as_of").distinct()
    covers = (F.col("symbol") == F.col("ticker")) & valid_at(F.col("start_date"), F.col("end_date"), F.col("as_of"))
    found = asked.join(memberships.select("symbol", "start_date", "end_date"), covers).groupBy("ticker", "as_of").agg(F.min_by(F.struct("start_date", "end_date"), "start_date").alias("_m"))
    rows = resolve_security(asked.join(found, ["ticker", "as_of"], "left"), tickers, "ticker", "as_of")
    priced = windows.select(F.col("symbol").alias("ticker"), "first_date", "last_date")
    rows = rows.join(priced, "ticker", "left")
    has_prices = F.coalesce((F.col("first_date") <= F.col("as_of")) & (F.col("as_of") <= F.col("last_date")), F.lit(False))
    proof = (
        F.when(F.col("_m").isNull(), "no_membership").when(F.col("seed_key").isNull(), "no_identity").when(~has_prices, "no_prices").otherwise("PASS")
    )
    return rows.select(
        "ticker", "as_of", F.col("_m.start_date").alias("start_date"), F.col("_m.end_date").alias("end_date"), "status", "seed_key", has_prices.alias("has_prices"), proof.alias("proof")
    )


def coverage_totals(coverage: DataFrame) -> DataFrame:
    """One row of totals over the coverage rows."""
    usable = F.col("quality_status") != "unusable"
    some = F.col("coverage_ratio") > 0
    absent = ~F.col("local_listing")
    return coverage.agg(
        F.count(F.lit(1)).alias("pit_securities"),
        F.count_if("rebalance_encountered").alias("rebalance_encountered"),
        F.count_if(some & usable).alias("valid_data"),
        F.count_if(~some).alias("missing"),
        F.count_if(some & (F.col("coverage_ratio") < 1)).alias("partial"),
        F.count_if(~usable).alias("unusable"),
        F.count_if(F.col("identity_status") == "UNRESOLVED").alias("unresolved_identity"),
        F.count_if(absent).alias("window_missing_listing"),
        F.count_if(absent & F.col("rebalance_encountered")).alias("rebalance_missing_listing"),
    )
