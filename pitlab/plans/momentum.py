"""Momentum signals for every rebalance date in one plan.

Bars hold one row per (symbol, session): ingestion guarantees it, and
``one_bar_per_session`` restores it for other tables. A symbol therefore has at most one
row per calendar day (36,525 in a century), so a window over a symbol is bounded by the
calendar and not by the size of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlab.operators.asof import count_before
from pitlab.operators.dedupe import keep_first
from pitlab.operators.intervals import expand_to_dates
from pitlab.operators.ranking import full_rank, top_n
from pitlab.params import MomentumParams

INSUFFICIENT = "insufficient_history"
FAILED_PRICE = "failed_price_filter"
FAILED_LIQUIDITY = "failed_liquidity_filter"
BAD_ANCHOR = "bad_anchor"
NOT_POSITIVE = "non_positive_momentum"
ELIGIBLE = "eligible"


def one_bar_per_session(bars: DataFrame) -> DataFrame:
    """The last stamp of a day represents it; ties are settled by the full row."""
    rest = [c for c in bars.columns if c not in ("symbol", "session", "ts")]
    return keep_first(bars, ["symbol", "session"], [-F.unix_micros("ts"), *rest])


def _own_bars() -> Window:
    return Window.partitionBy("symbol").orderBy("session")


def momentum_features(bars: DataFrame, params: MomentumParams) -> DataFrame:
    """Per bar: own bar count, momentum P[t-skip] / P[t-lookback] - 1, mean dollar volume.

    Offsets count the symbol's own bars. The trailing mean is a difference of exact decimal
    running sums, one step per row whatever the window. NULL where history is short, an
    anchor is missing, or the lookback price is zero. All windows share one sort.
    """
    w = _own_bars()
    traded = F.sum(F.col("close") * F.col("volume")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    carried = [c for c in bars.columns if c not in ("open", "high", "low", "ts", "volume", "adjusted_close")]
    base = bars.select(
        *carried,
        F.row_number().over(w).cast("long").alias("n_bars"),
        F.lag("adjusted_close", params.skip).over(w).alias("skip_price"),
        F.lag("adjusted_close", params.lookback).over(w).alias("lookback_price"),
        traded.alias("_traded"),
    )
    earlier = F.coalesce(F.lag("_traded", params.liquidity_window).over(w), F.lit(0))
    mean = (F.col("_traded") - earlier).cast("double") / params.liquidity_window
    ratio = F.try_divide(F.col("skip_price").cast("double"), F.col("lookback_price").cast("double")) - 1
    return base.select(
        *carried,
        "n_bars",
        "skip_price",
        "lookback_price",
        ratio.alias("momentum"),
        F.when(F.col("n_bars") >= params.liquidity_window, mean).alias("avg_dollar_volume"),
    )


def features_at(bars: DataFrame, calendar: DataFrame, dates: DataFrame, params: MomentumParams) -> DataFrame:
    """Features of the latest bar on or before each date, for every symbol with such a bar.

    The as-of step rides on the feature window: a bar answers the dates from its session up
    to the symbol's next one, found by comparing how many dates precede each. Only bars
    that answer a date leave the window.
    """
    numbered = dates.select("as_of", F.row_number().over(Window.orderBy("as_of")).alias("_n"))
    before = F.broadcast(count_before(calendar, dates))
    features = momentum_features(bars.join(before, "session"), params)
    following = F.lead("before").over(_own_bars())
    total = numbered.agg(F.max("_n")).scalar()
    reach = features.withColumn("_to", F.coalesce(following, total)).filter(F.col("_to") > F.col("before"))
    return (
        reach.withColumn("_n", F.explode(F.sequence(F.col("before") + 1, F.col("_to"))))
        .join(F.broadcast(numbered), "_n")
        .drop("_n", "_to", "before")
    )


def disposition(params: MomentumParams) -> Column:
    """First failing stage wins. A bad anchor and momentum <= 0 count under no filter."""
    return (
        F.when(F.coalesce("n_bars", F.lit(0)) < params.lookback + 1, INSUFFICIENT)
        .when(F.col("close") < params.min_price, FAILED_PRICE)
        .when(F.col("avg_dollar_volume").isNull() | (F.col("avg_dollar_volume") < params.min_dollar_volume), FAILED_LIQUIDITY)
        .when(F.col("momentum").isNull(), BAD_ANCHOR)
        .when(F.col("momentum") <= 0, NOT_POSITIVE)
        .otherwise(ELIGIBLE)
    )


def all_symbols_universe(bars: DataFrame, dates: DataFrame) -> DataFrame:
    """Without an index: every symbol that has bars, on every date."""
    always = bars.select("symbol").distinct().select(
        "symbol", F.lit("0001-01-01").cast("date").alias("start_date"), F.lit(None).cast("date").alias("end_date")
    )
    return expand_to_dates(always, dates.select("as_of")).select("as_of", "symbol")


def evaluate(
    bars: DataFrame,
    calendar: DataFrame,
    dates: DataFrame,
    params: MomentumParams,
    universe: DataFrame | None = None,
    unusable: DataFrame | None = None,
) -> DataFrame:
    """Disposition of every priced, usable member on every date.

    A member whose first bar lies after the date has no history yet, so it is judged and
    not lost.
    """
    members = all_symbols_universe(bars, dates) if universe is None else universe.select("as_of", "symbol").distinct()
    if universe is not None:
        members = members.join(bars.select("symbol").distinct(), "symbol", "left_semi")
    if unusable is not None:
        members = members.join(unusable.select("symbol").distinct(), "symbol", "left_anti")
    features = features_at(bars, calendar, dates, params)
    return members.join(features, ["as_of", "symbol"], "left").withColumn("disposition", disposition(params))


def momentum_signals(evaluated: DataFrame, params: MomentumParams) -> DataFrame:
    """Top N of each date: momentum descending, symbol ascending, no padding."""
    eligible = evaluated.filter(F.col("disposition") == ELIGIBLE)
    return top_n(eligible, ["as_of"], "momentum", "symbol", params.top_n).select("as_of", "symbol", "momentum", "rank")


def ranked_candidates(evaluated: DataFrame) -> DataFrame:
    """All eligible names of each date with their rank."""
    eligible = evaluated.filter(F.col("disposition") == ELIGIBLE).select("as_of", "symbol", "momentum")
    return full_rank(eligible, ["as_of"], "momentum", "symbol")


def filter_counts(evaluated: DataFrame, params: MomentumParams) -> DataFrame:
    """Outcome counts per date; ``selected`` is at most top_n."""
    def n(state: str) -> Column:
        return F.count_if(F.col("disposition") == state)

    return evaluated.groupBy("as_of").agg(
        n(INSUFFICIENT).alias("insufficient_history"),
        n(FAILED_PRICE).alias("failed_price_filter"),
        n(FAILED_LIQUIDITY).alias("failed_liquidity_filter"),
        n(ELIGIBLE).alias("momentum_eligible"),
        F.least(n(ELIGIBLE), F.lit(params.top_n)).cast("long").alias("selected"),
    )


def longest_history(bars: DataFrame) -> DataFrame:
    """Greatest bar count of a symbol."""
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("bars"))


def ensure_sufficient_history(bars: DataFrame, lookback: int) -> None:
    have = longest_history(bars).first()["bars"]
    if have < lookback + 1:
        raise ValueError(f"insufficient history: need {lookback + 1} bars, the longest series has {have}")
