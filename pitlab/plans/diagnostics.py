"""What each rebalance saw, and what a run as a whole could not see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlab.operators.rows import side_by_side
from pitlab.params import MomentumParams
from pitlab.plans.momentum import INSUFFICIENT, filter_counts
from pitlab.plans.universe import universe_slice

COUNTS = ["insufficient_history", "failed_price_filter", "failed_liquidity_filter", "momentum_eligible", "selected"]


def rebalance_diagnostics(
    dates: DataFrame,
    universe: DataFrame,
    bars: DataFrame,
    evaluated: DataFrame,
    params: MomentumParams,
    unusable: DataFrame | None = None,
) -> DataFrame:
    """Per date: members, missing, unusable and the outcome of every filter."""
    states = universe_slice(universe, bars, unusable).groupBy("as_of").agg(
        F.count(F.lit(1)).alias("universe_members"),
        F.count_if(F.col("state") == "missing").alias("missing_market_data"),
        F.count_if(F.col("state") == "unusable").alias("unusable_market_data"),
    )
    names = ["universe_members", "missing_market_data", "unusable_market_data", *COUNTS]
    return (
        dates.select("as_of")
        .join(states, "as_of", "left")
        .join(filter_counts(evaluated, params), "as_of", "left")
        .fillna(0, names)
    )


def coverage_snapshot(
    diagnostics: DataFrame, universe: DataFrame, bars: DataFrame, evaluated: DataFrame, unusable: DataFrame | None = None
) -> DataFrame:
    """One row for the run: peak and distinct members, and how many had usable history."""
    states = universe_slice(universe, bars, unusable)
    short = evaluated.filter(F.col("disposition") == INSUFFICIENT).select("symbol").distinct().withColumn("_short", F.lit(True))
    per_symbol = states.groupBy("symbol").agg(F.min("state").alias("state")).join(short, "symbol", "left")
    is_short = F.col("_short").isNotNull()
    members = per_symbol.agg(
        F.count(F.lit(1)).alias("universe_members"),
        F.count_if((F.col("state") == "priced") & ~is_short).alias("market_data_available"),
        F.count_if(F.col("state") == "missing").alias("missing_market_data"),
        F.count_if(F.col("state") == "unusable").alias("unusable_market_data"),
        F.count_if(is_short).alias("insufficient_history"),
    )
    run = diagnostics.agg(
        F.max("universe_members").alias("universe_member_peak"),
        F.max_by("momentum_eligible", "as_of").alias("momentum_eligible"),
        F.max_by("selected", "as_of").alias("selected"),
    )
    return side_by_side(members, run)


def missing_summary(missing: DataFrame, preview: int = 20) -> DataFrame:
    """Distinct missing names, the worst date, the dates affected and the first names.

    The preview takes the first names by rank; the whole list is never gathered.
    """
    per_date = missing.groupBy("as_of").agg(F.count_distinct("symbol").alias("n")).agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("peak"), F.count(F.lit(1)).alias("dates")
    )
    names = missing.select("symbol").distinct()
    total = names.agg(F.count(F.lit(1)).alias("distinct_missing"))
    first = names.orderBy("symbol").limit(preview).agg(
        F.array_join(F.array_sort(F.collect_list("symbol")), ", ").alias("sample")
    )
    return side_by_side(total, per_date, first)


def warnings(
    diagnostics: DataFrame, missing: DataFrame, unusable: DataFrame, lookback: int, explicit_signal_start: bool, preview: int = 20
) -> DataFrame:
    """Run warnings as rows (code, n, sample) instead of prose."""
    def first_names(df: DataFrame) -> DataFrame:
        names = df.select("symbol").distinct()
        return names.orderBy("symbol").limit(preview).agg(
            F.array_join(F.array_sort(F.collect_list("symbol")), ", ").alias("sample")
        ).select(names.agg(F.count(F.lit(1))).scalar().alias("n"), "sample")

    gone = first_names(missing).select(F.lit("missing_market_data").alias("code"), "n", "sample")
    bad = first_names(unusable).select(F.lit("unusable_price_series").alias("code"), "n", "sample")
    none = diagnostics.agg(F.count(F.lit(1)).alias("_d")).filter("_d = 0").select(
        F.lit("no_rebalance").alias("code"), F.lit(0).cast("long").alias("n"), F.lit("").alias("sample")
    )
    first = diagnostics.agg(F.min_by(F.struct("as_of", *COUNTS), "as_of").alias("f")).select("f.*")
    cold = first.filter(
        F.lit(explicit_signal_start)
        & (F.col("selected") == 0)
        & (F.col("momentum_eligible") == 0)
        & (F.col("insufficient_history") > 0)
    ).select(
        F.lit("insufficient_warmup").alias("code"),
        F.col("insufficient_history").alias("n"),
        F.concat(F.lit("needs "), F.lit(str(lookback + 1)), F.lit(" bars by "), F.date_format("as_of", "yyyy-MM-dd")).alias("sample"),
    )
    return gone.unionByName(bad).filter("n > 0").unionByName(none).unionByName(cold)


def quality_verdict(
    unvalued: DataFrame, unusable: DataFrame, fills: DataFrame, held_prices: DataFrame, missing: DataFrame
) -> DataFrame:
    """COMPLETE, or DATA_QUALITY_INCOMPLETE with the counts that say why.

    Inputs are symbol tables; a stale mark is a symbol that is unvalued now and was once
    held at an old price.
    """
    def distinct(df: DataFrame) -> DataFrame:
        return df.select("symbol").distinct()

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(name))

    stuck, bad = distinct(unvalued), distinct(unusable)
    row = side_by_side(
        count(stuck, "stuck_positions"),
        count(distinct(fills).join(bad, "symbol", "left_semi"), "unusable_fills"),
        count(stuck.join(distinct(held_prices), "symbol", "left_semi"), "stale_marks"),
        count(distinct(missing), "missing_market_data"),
        count(bad, "unusable_symbols"),
    )
    flaws = F.col("stuck_positions") + F.col("unusable_fills") + F.col("stale_marks") + F.col("missing_market_data") + F.col("unusable_symbols")
    return row.withColumn("status", F.when(flaws > 0, "DATA_QUALITY_INCOMPLETE").otherwise("COMPLETE"))
