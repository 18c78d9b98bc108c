"""Vendor records with changing column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlab.functions.text import normalize_symbol
from pitlab.schemas import PRICE


def _pick(df: DataFrame, *names: str) -> Column:
    """The first of the alternative columns that holds a non-empty text.

    Spark resolves names without regard to case, so each spelling is taken once.
    """
    have = {c.lower() for c in df.columns}
    wanted = dict.fromkeys(n.lower() for n in names)
    present = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in wanted if n in have]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def _number(text: Column) -> Column:
    return F.when(F.lower(text).isin("none", "nan"), F.lit(None)).otherwise(text).try_cast(PRICE)


def normalize_vendor_bars(raw: DataFrame, adjusted: bool) -> DataFrame:
    """Bars from records named ``Date/Open/…`` or ``date/open/…``.

    Open, high and low default to the close, an unreadable volume to 0, and a record without
    a date or close is dropped. The close is the adjusted close only in adjusted mode.
    """
    day = F.try_to_date(F.substring(_pick(raw, "Date", "date", "timestamp"), 1, 10), "yyyy-MM-dd")
    close = _number(_pick(raw, "Close", "close"))
    volume = _pick(raw, "Volume", "volume").try_cast("double")
    # Truncated toward zero; NaN has no whole part and counts as unreadable.
    whole = F.when(F.isnan(volume) | volume.isNull(), F.lit(0.0)).otherwise(volume)
    bars = raw.select(
        normalize_symbol("symbol").alias("symbol"),
        F.to_timestamp(day).alias("ts"),
        day.alias("session"),
        *[F.coalesce(_number(_pick(raw, n.title(), n)), close).alias(n) for n in ("open", "high", "low")],
        close.alias("close"),
        (close if adjusted else F.lit(None).cast(PRICE)).alias("adjusted_close"),
        whole.cast("long").alias("volume"),
    )
    return bars.filter(F.col("session").isNotNull() & F.col("close").isNotNull())
