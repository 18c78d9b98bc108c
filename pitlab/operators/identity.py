"""Temporal identity: ticker and day to security, never guessed.

A ticker resolves on a day only if exactly one catalog row covers it. The catalog is first
cut into stretches where that holds; a lookup is then one left join on the ticker whose
right side matches at most once. Spark broadcasts the stretches while they are small, so
bars are not shuffled at all; beyond that, adaptive execution splits a ticker that holds a
third of them.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlab.functions.dates import day, overlaps_window, valid_at, valid_through
from pitlab.functions.text import listing_id, position_key
from pitlab.operators.intervals import overlap_counts, timeline

LISTING = "listing"
# Fixed value: the word by which catalogs mark vendor tickers, unless a caller names another.
VENDOR = "yahoo"
RESOLVED = "RESOLVED"
UNRESOLVED = "UNRESOLVED"


def ticker_timeline(tickers: DataFrame, scheme: str) -> DataFrame:
    """When each ticker of a scheme means exactly one security, and since when its row runs."""
    rows = tickers.filter(F.col("scheme") == scheme).select("ticker", "valid_from", "valid_to", "seed_key")
    return timeline(rows, ["ticker"], "valid_from", "valid_to", ["seed_key", F.col("valid_from").alias("since")])


def resolve_security(
    rows: DataFrame, tickers: DataFrame, ticker: str, on_day: str, scheme: str = LISTING, prefix: str = ""
) -> DataFrame:
    """Adds ``{prefix}status`` and ``{prefix}seed_key``."""
    found = _at(rows, ticker_timeline(tickers, scheme), ticker, on_day, {"seed_key": f"{prefix}seed_key"})
    status = F.when(F.col(f"{prefix}seed_key").isNull(), UNRESOLVED).otherwise(RESOLVED)
    return found.withColumn(f"{prefix}status", status)


def _at(rows: DataFrame, segments: DataFrame, ticker: str, on_day: str, names: dict[str, str]) -> DataFrame:
    """Left join to the one stretch of the ticker that holds the day; ``names`` renames its columns."""
    right = segments.select(
        F.col("ticker").alias("_t"), F.col("seg_from").alias("_f"), F.col("seg_to").alias("_u"),
        *[F.col(c).alias(n) for c, n in names.items()],
    )
    hit = (F.col(ticker) == F.col("_t")) & valid_at(F.col("_f"), F.col("_u"), F.col(on_day))
    return rows.join(right, hit, "left").drop("_t", "_f", "_u")


def has_vendor_mapping(rows: DataFrame, tickers: DataFrame, ticker: str, vendor_scheme: str = VENDOR) -> DataFrame:
    """Rows whose ticker has any vendor row, at any time."""
    known = tickers.filter(F.col("scheme") == vendor_scheme).select(F.col("ticker").alias(ticker))
    return rows.join(known, ticker, "left_semi")


def vendor_symbols(requests: DataFrame, tickers: DataFrame, vendor_scheme: str = VENDOR) -> DataFrame:
    """For (listing, w_start, w_end): the names to read, in order, and the preferred one.

    The listing comes first, then vendor tickers of the same security that overlap the
    window (catalog order ``ord`` if present, else valid_from and ticker).
    """
    catalog = tickers if "ord" in tickers.columns else tickers.withColumn("ord", F.lit(0).cast("long"))
    asked = requests.select("listing", "w_start", "w_end").distinct()
    listed = catalog.filter(F.col("scheme") == LISTING).select(
        F.col("ticker").alias("listing"), "valid_from", "valid_to", "seed_key"
    )
    seeds = (
        asked.join(listed, "listing")
        .filter(overlaps_window(F.col("valid_from"), F.col("valid_to"), F.col("w_start"), F.col("w_end")))
        .select("listing", "w_start", "w_end", "seed_key")
        .distinct()
    )
    vendor = catalog.filter(F.col("scheme") == vendor_scheme).select(
        "seed_key", F.col("ticker").alias("name"), "valid_from", "valid_to", "ord"
    )
    names = (
        seeds.join(vendor, "seed_key")
        .filter(overlaps_window(F.col("valid_from"), F.col("valid_to"), F.col("w_start"), F.col("w_end")))
        .filter(F.col("name") != F.col("listing"))
        .groupBy("listing", "w_start", "w_end", "name")
        .agg(F.min(F.struct("ord", "valid_from")).alias("_at"))
        # One entry per vendor name a security ever had: catalog depth, not data size.
        .groupBy("listing", "w_start", "w_end")
        .agg(F.array_sort(F.collect_list(F.struct("_at", "name"))).alias("_names"))
    )
    others = F.transform(F.col("_names"), lambda x: x["name"])
    ordered = F.concat(F.array("listing"), F.coalesce(others, F.array().cast("array<string>")))
    return asked.join(names, ["listing", "w_start", "w_end"], "left").select(
        "listing",
        "w_start",
        "w_end",
        ordered.alias("fetch_symbols"),
        F.coalesce(F.get(ordered, F.lit(1)), F.col("listing")).alias("preferred_symbol"),
    )


def substitute_vendor_series(bars: DataFrame, names: DataFrame) -> DataFrame:
    """Bars per listing: those stored under its vendor names if there are any, else its own.

    The choice is one flag per listing from a small aggregate, not a window over its bars.
    """
    wanted = names.select("listing", F.posexplode("fetch_symbols").alias("_n", "symbol"))
    priced = bars.select("symbol").distinct()
    uses_vendor = (
        wanted.filter("_n > 0").join(priced, "symbol", "left_semi").select("listing").distinct().withColumn("_v", F.lit(True))
    )
    chosen = wanted.join(uses_vendor, "listing", "left").filter(
        F.when(F.col("_v"), F.col("_n") > 0).otherwise(F.col("_n") == 0)
    )
    return bars.join(chosen.select("listing", "symbol", F.col("_v").isNotNull().alias("is_vendor")), "symbol")


def assess_identity(bars: DataFrame, tickers: DataFrame, vendor_scheme: str = VENDOR, listing: str = "symbol") -> DataFrame:
    """Bars with listing and vendor seeds and the verdict of their series.

    A series is named by its ``listing`` column, which may differ from the ``symbol`` its bars are stored under (see
    ``substitute_vendor_series``): the listing is resolved as such, the symbol as a vendor ticker. A resolved listing
    whose vendor ticker is not the same security makes the whole series ``identity_mismatch``.
    """
    seeded = _at(bars, ticker_timeline(tickers, LISTING), listing, "session", {"seed_key": "listing_seed"})
    seeded = _at(seeded, ticker_timeline(tickers, vendor_scheme), "symbol", "session", {"seed_key": "vendor_seed"})
    wrong = F.col("listing_seed").isNotNull() & ~F.col("listing_seed").eqNullSafe(F.col("vendor_seed"))
    mapped = tickers.filter(F.col("scheme") == vendor_scheme).select(F.col("ticker").alias("_v")).distinct()
    symbols = seeded.groupBy(listing, F.col("symbol").alias("_symbol")).agg(F.bool_or(wrong).alias("_wrong"))
    known = symbols.join(mapped, F.col("_symbol") == F.col("_v"), "left")
    verdict = known.groupBy(listing).agg(F.bool_or("_wrong").alias("mismatch"), F.bool_or(F.col("_v").isNotNull()).alias("has_vendor"))
    return seeded.join(verdict, listing)


def apply_identity(bars: DataFrame, tickers: DataFrame, vendor_scheme: str = VENDOR, listing: str = "symbol") -> tuple[DataFrame, DataFrame]:
    """(clipped bars, unusable listings with reason).

    Mismatched series are reported and left as they are; of the others, those with a vendor
    mapping lose the bars that it does not cover.
    """
    assessed = assess_identity(bars, tickers, vendor_scheme, listing)
    keep = F.col("mismatch") | ~F.col("has_vendor") | F.col("vendor_seed").isNotNull()
    unusable = assessed.filter("mismatch").select(F.col(listing).alias("symbol")).distinct().withColumn("reason", F.lit("identity_mismatch"))
    return assessed.filter(keep).select(*bars.columns), unusable


def resolve_identity(rows: DataFrame, tickers: DataFrame, memberships: DataFrame, ticker: str, on_day: str) -> DataFrame:
    """Adds status, security_id, listing_id and position_key to each (ticker, day) row.

    One listing row covering the day gives the security. Otherwise the index interval that
    covers it gives a listing, and if there is none the occupancy is unknown. Two intervals
    of one ticker on one day cannot share a slot: ``occupancy_conflict`` is then true.
    """
    listed = ticker_timeline(tickers, LISTING)
    found = _at(rows, listed, ticker, on_day, {"seed_key": "security_id", "since": "_since"})
    member = memberships.select(F.col("symbol").alias("ticker"), "start_date", "end_date").distinct()
    alone = timeline(member, ["ticker"], "start_date", "end_date", [F.col("start_date").alias("occupied")])
    found = _at(found, alone, ticker, on_day, {"occupied": "_occupied"})
    # Days on which intervals overlap: open intervals less the single stretches.
    clash = overlap_counts(member, ["ticker"], "start_date", "end_date").filter("overlap_count > 0")
    asked = found.filter(F.col("_occupied").isNull()).select(F.col(ticker).alias("_t"), F.col(on_day).alias("_d")).distinct()
    covered = (F.col("_t") == F.col("ticker")) & valid_at(F.col("start_date"), F.col("end_date"), F.col("_d"))
    disputed = asked.join(clash, covered, "left_semi").select(
        F.col("_t").alias(ticker), F.col("_d").alias(on_day), F.lit(True).alias("_dispute")
    )
    found = found.join(disputed, [ticker, on_day], "left")
    listing = listing_id(F.col(ticker), F.coalesce("_since", "_occupied"))
    return found.select(
        *rows.columns,
        F.when(F.col("security_id").isNull(), UNRESOLVED).otherwise(RESOLVED).alias("status"),
        "security_id",
        listing.alias("listing_id"),
        position_key(F.col("security_id"), listing, F.col(ticker)).alias("position_key"),
        F.col("_dispute").isNotNull().alias("occupancy_conflict"),
    )


def attach_signal_identities(signals: DataFrame, tickers: DataFrame, memberships: DataFrame) -> DataFrame:
    """Signals with identity; two index intervals of one ticker on one date are an error."""
    attached = resolve_identity(signals, tickers, memberships, "symbol", "as_of")
    message = F.concat(F.lit("duplicate index occupancy for ticker "), F.col("symbol"))
    guarded = F.when(F.col("occupancy_conflict"), F.raise_error(message).cast("string")).otherwise(F.col("position_key"))
    return attached.withColumn("position_key", guarded).drop("occupancy_conflict")


def known_terminations(ended: DataFrame, securities: DataFrame, tickers: DataFrame) -> DataFrame:
    """Marks rows (symbol, last_bar, session) whose listing is known to have ended.

    The tape must stop before the session, and the security must be DELISTED: the one
    resolved at the last bar, or failing a resolution any whose listing row holds the last
    bar with both ends included.
    """
    listed = tickers.filter(F.col("scheme") == LISTING).join(securities.select("seed_key", "status"), "seed_key")
    right = listed.select(
        F.col("ticker").alias("_t"), "valid_from", "valid_to", F.col("status").alias("_status")
    )
    asked = ended.select("symbol", "last_bar").distinct()
    touching = (F.col("symbol") == F.col("_t")) & (
        valid_at(F.col("valid_from"), F.col("valid_to"), F.col("last_bar"))
        | valid_through(F.col("valid_from"), F.col("valid_to"), F.col("last_bar"))
    )
    half_open = valid_at(F.col("valid_from"), F.col("valid_to"), F.col("last_bar"))
    closed = valid_through(F.col("valid_from"), F.col("valid_to"), F.col("last_bar"))
    delisted = F.col("_status") == "DELISTED"
    verdict = asked.join(right, touching, "left").groupBy("symbol", "last_bar").agg(
        F.count_if(half_open).alias("_n"),
        F.coalesce(F.bool_or(half_open & delisted), F.lit(False)).alias("_at"),
        F.coalesce(F.bool_or(closed & delisted), F.lit(False)).alias("_through"),
    )
    known = F.when(F.col("_n") == 1, F.col("_at")).otherwise(F.col("_through"))
    return (
        ended.join(verdict, ["symbol", "last_bar"], "left")
        .withColumn("terminated", (F.col("last_bar") < F.col("session")) & F.coalesce(known, F.lit(False)))
        .drop("_n", "_at", "_through")
    )


def ticker_history(tickers: DataFrame, start: date | Column, end: date | Column) -> tuple[DataFrame, DataFrame]:
    """(listing tickers used by more than one security in the window, securities with more than one listing ticker)."""
    listed = tickers.filter(F.col("scheme") == LISTING)
    recycled = (
        listed.filter(overlaps_window(F.col("valid_from"), F.col("valid_to"), day(start), day(end)))
        .groupBy("ticker")
        .agg(F.count_distinct("seed_key").alias("securities"))
        .filter("securities > 1")
    )
    renamed = listed.groupBy("seed_key").agg(F.count_distinct("ticker").alias("tickers")).filter("tickers > 1")
    return recycled, renamed


def retarget_listings(positions: DataFrame, targets: DataFrame) -> DataFrame:
    """Positions take the ticker and identity of the target with the same key; sizes stay.

    A target without an identity changes nothing.
    """
    named = ("symbol", "security_id", "listing_id")
    fresh = targets.filter(F.col("listing_id").isNotNull()).select(
        "portfolio_id", "position_key", F.struct(*named).alias("_new")
    )
    joined = positions.join(fresh, ["portfolio_id", "position_key"], "left")
    renewed = [
        F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in named else F.col(c)
        for c in positions.columns
    ]
    return joined.select(*renewed)
