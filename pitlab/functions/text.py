"""Ticker and key text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: removed index members carry this suffix in snapshot files (year and month).
REMOVAL_SUFFIX = r"-[0-9]{6}$"
# Fixed value: stands for the exchange in a listing id where none is known.
UNKNOWN_EXCHANGE = "_"


def normalize_symbol(c: Column | str) -> Column:
    return F.upper(F.trim(F.col(c) if isinstance(c, str) else c))


def strip_removal_suffix(c: Column | str) -> Column:
    """``AAL-199702`` → ``AAL``; class punctuation such as ``BRK.B`` is kept.

    A bare suffix with nothing before it is not a ticker plus suffix, so it stays.
    """
    name = normalize_symbol(c)
    return F.when(name.rlike("^.+" + REMOVAL_SUFFIX), F.regexp_replace(name, REMOVAL_SUFFIX, "")).otherwise(name)


def listing_id(ticker: Column, valid_from: Column, exchange: Column | None = None) -> Column:
    """``exchange:ticker:valid_from``, or ``exchange:ticker:occupancy-unknown`` without a date."""
    venue = F.lit(UNKNOWN_EXCHANGE)
    if exchange is not None:
        venue = F.coalesce(F.nullif(F.upper(F.trim(exchange)), F.lit("")), venue)
    since = F.coalesce(F.date_format(valid_from, "yyyy-MM-dd"), F.lit("occupancy-unknown"))
    return F.concat_ws(":", venue, normalize_symbol(ticker), since)


def position_key(security_id: Column, listing: Column, symbol: Column) -> Column:
    """Booking key: the security if resolved, else the listing, never a raw ticker."""
    unknown = F.concat_ws(":", F.lit(UNKNOWN_EXCHANGE), normalize_symbol(symbol), F.lit("occupancy-unknown"))
    return F.when(security_id.isNotNull(), F.concat(F.lit("security:"), security_id)).otherwise(
        F.concat(F.lit("listing:"), F.coalesce(listing, unknown))
    )


def provisional_seed_key(ticker: Column, start: Column, end: Column) -> Column:
    return F.concat_ws(
        ":",
        F.lit("pit"),
        F.upper(ticker),
        F.date_format(start, "yyyy-MM-dd"),
        F.coalesce(F.date_format(end, "yyyy-MM-dd"), F.lit("open")),
    )


def format_interval(start: Column, end: Column) -> Column:
    return F.concat(
        F.date_format(start, "yyyy-MM-dd"), F.lit("→"), F.coalesce(F.date_format(end, "yyyy-MM-dd"), F.lit("open"))
    )


def fixed_point(c: Column) -> Column:
    """Decimal as plain text, NULL as the empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))


def alias_tokens(c: Column) -> Column:
    """Tickers named in a must-not-alias text such as ``BUYR/BUYER, current PI``."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[,/]"), lambda p: F.trim(p))
    return F.array_distinct(
        F.filter(parts, lambda p: (p != "") & ~F.lower(p).startswith("current ") & (p == F.upper(p)))
    )


def is_alias_identity(vendor_symbol: Column, name: Column, must_not_alias: Column) -> Column:
    """True when the resolved symbol (suffix cut) or a word of its name is forbidden."""
    tokens = alias_tokens(must_not_alias)
    stem = F.element_at(F.split(F.upper(F.coalesce(vendor_symbol, F.lit(""))), "-"), 1)
    words = F.filter(F.split(F.upper(F.coalesce(name, F.lit(""))), r"\s+"), lambda w: w != "")
    return F.array_contains(tokens, stem) | F.arrays_overlap(tokens, words)
