"""Calendars, features, signals and their diagnostics."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlab.operators.asof import asof_join, asof_stored
from pitlab.operators.calendars import month_starts, rebalance_dates, session_timestamps
from pitlab.params import MomentumParams
from pitlab.plans import momentum
from pitlab.plans.universe import universe_as_of, universe_slice
from pitlab.registry import Query
from pitlab.session import shared_folder
from pitlab.sources.bars import write_bucketed
from pitlab.standins.frames import Standins
from pitlab.standins.sql import with_tables

PARAMS = MomentumParams(lookback=252, skip=21, top_n=10, min_price=5_000.0, liquidity_window=20, min_dollar_volume=1_200_000.0)
SHORT = MomentumParams(lookback=60, skip=5, top_n=5, min_price=5_000.0, liquidity_window=20, min_dollar_volume=1_200_000.0)


def _feature_ctes(p: MomentumParams) -> dict[str, str]:
    return {
        "feat": f"""
  SELECT symbol, session, LEAD(session) OVER w AS until, ROW_NUMBER() OVER w AS n_bars, CAST(close AS DOUBLE) AS close,
         CASE WHEN CAST(LAG(adjusted_close, {p.lookback}) OVER w AS DOUBLE) = 0 THEN NULL
              ELSE CAST(LAG(adjusted_close, {p.skip}) OVER w AS DOUBLE) / CAST(LAG(adjusted_close, {p.lookback}) OVER w AS DOUBLE) - 1 END AS momentum,
         CASE WHEN COUNT(*) OVER f = {p.liquidity_window} THEN CAST(SUM(close * volume) OVER f AS DOUBLE) / {p.liquidity_window} END AS adv
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY session),
       f AS (PARTITION BY symbol ORDER BY session ROWS BETWEEN {p.liquidity_window - 1} PRECEDING AND CURRENT ROW)""",
        "judged": f"""
  SELECT u.as_of, u.symbol, f.momentum, f.adv, f.close, COALESCE(f.n_bars, 0) AS n_bars,
         CASE WHEN COALESCE(f.n_bars, 0) < {p.lookback + 1} THEN 'insufficient_history'
              WHEN f.close < {p.min_price} THEN 'failed_price_filter'
              WHEN f.adv IS NULL OR f.adv < {p.min_dollar_volume} THEN 'failed_liquidity_filter'
              WHEN f.momentum IS NULL THEN 'bad_anchor'
              WHEN f.momentum <= 0 THEN 'non_positive_momentum' ELSE 'eligible' END AS disposition
  FROM members u LEFT JOIN feat f ON f.symbol = u.symbol AND f.session <= u.as_of AND (f.until IS NULL OR u.as_of < f.until)""",
    }


def signal_ctes(p: MomentumParams, members: str = "SELECT as_of, symbol FROM universe WHERE symbol IN (SELECT symbol FROM bars)") -> dict[str, str]:
    return {
        "members": members,
        **_feature_ctes(p),
        "signals": f"""
  SELECT * FROM (SELECT as_of, symbol, momentum, ROW_NUMBER() OVER (PARTITION BY as_of ORDER BY momentum DESC, symbol) AS rank
                 FROM judged WHERE disposition = 'eligible') q WHERE rank <= {p.top_n}""",
    }


EVERYONE = "SELECT r.as_of, b.symbol FROM rebalances r CROSS JOIN (SELECT DISTINCT symbol FROM bars) b"


def evaluated(s: Standins, p: MomentumParams = PARAMS, index: bool = True) -> DataFrame:
    universe = universe_as_of(s.memberships, s.rebalances) if index else None
    return momentum.evaluate(s.bars, s.calendar, s.rebalances, p, universe)


def signals(s: Standins, p: MomentumParams = PARAMS, index: bool = True) -> DataFrame:
    return momentum.momentum_signals(evaluated(s, p, index), p)


def _features(s: Standins) -> DataFrame:
    f = momentum.momentum_features(s.bars, PARAMS)
    return f.select("symbol", "session", "n_bars", "momentum", "avg_dollar_volume")


def _asof(s: Standins) -> DataFrame:
    """Each order with the latest bar of its name on or before its session."""
    left = s.orders.select("order_id", F.col("position_key").alias("symbol"), F.col("session").alias("on_day"))
    right = s.bars.select("symbol", "session", "close", "volume")
    joined = asof_join(left, right, "symbol", "on_day", "session", prefix="bar_")
    return joined.select(
        "order_id", "symbol", "on_day", "bar_session", F.col("bar_close").cast("double").alias("bar_close"), "bar_volume"
    )


def _asof_stored(s: Standins) -> DataFrame:
    """As ``_asof``, from a stored table that is bucketed by symbol and month."""
    left = s.orders.select("order_id", F.col("position_key").alias("symbol"), F.col("session").alias("on_day"))
    name = f"bars_{uuid.uuid4().hex}"
    buckets = int(s.spark.conf.get("spark.sql.shuffle.partitions"))
    stored = write_bucketed(s.bars.select("symbol", "session", "close", "volume"), name, f"{shared_folder(s.spark)}/pitlab/{name}", buckets)
    joined = asof_stored(left, stored, "symbol", "on_day", "session", prefix="bar_")
    return joined.select("order_id", "symbol", "on_day", "bar_session", F.col("bar_close").cast("double").alias("bar_close"), "bar_volume")


def _month_starts(s: Standins) -> DataFrame:
    days = month_starts(s.spark, date(1995, 1, 15), date(2001, 11, 4))
    return universe_as_of(s.memberships, days).groupBy("as_of").agg(F.count(F.lit(1)).alias("members"))


def _slice(s: Standins) -> DataFrame:
    unusable = s.securities.filter(F.col("status") == "DELISTED").select(
        F.concat(F.lit("S"), F.substring("seed_key", 5, 6)).alias("symbol")
    )
    states = universe_slice(universe_as_of(s.memberships, s.rebalances), s.bars, unusable)
    return states.groupBy("as_of", "state").agg(F.count(F.lit(1)).alias("members"))


T = with_tables
QUERIES: dict[str, Query] = {
    "trading_calendar": Query(lambda s: s.calendar, T("calendar", "SELECT * FROM calendar"), "A04 W13 J30"),
    "session_timestamps": Query(
        lambda s: session_timestamps(s.bars),
        T("bars", "SELECT session, date_trunc('day', MIN(ts)) + INTERVAL '9 hours 30 minutes' AS session_ts FROM bars GROUP BY session"),
        "W15",
    ),
    "rebalance_dates": Query(
        lambda s: rebalance_dates(s.calendar, warmup_sessions=253),
        T(
            "calendar",
            """SELECT session AS as_of, next_session AS execution_session, ROW_NUMBER() OVER (ORDER BY session) AS n FROM calendar
               WHERE idx >= 253 AND (prev_session IS NULL OR date_trunc('month', prev_session) <> date_trunc('month', session))""",
        ),
        "W06 P16",
    ),
    "month_start_members": Query(
        _month_starts,
        T(
            "memberships",
            """SELECT d.as_of, COUNT(DISTINCT m.symbol) AS members
               FROM (SELECT DATE '1995-01-15' AS as_of UNION SELECT CAST(x AS DATE) FROM generate_series(DATE '1995-02-01', DATE '2001-11-04', INTERVAL '1' MONTH) g(x)) d
               JOIN memberships m ON m.start_date <= d.as_of AND (m.end_date IS NULL OR d.as_of < m.end_date) GROUP BY d.as_of""",
        ),
        "W07 P08",
    ),
    "momentum_features": Query(
        _features,
        T("bars", "SELECT symbol, session, n_bars, momentum, adv AS avg_dollar_volume FROM feat", {"feat": _feature_ctes(PARAMS)["feat"]}),
        "W01 W02 A03",
    ),
    "momentum_signals": Query(
        signals,
        T("bars universe", "SELECT as_of, symbol, momentum, rank FROM signals", signal_ctes(PARAMS)),
        "T01 T02 W01 W02 W03 J01 J04 P11 P12 P13 P15 P07",
    ),
    "momentum_signals_unrestricted": Query(
        lambda s: signals(s, SHORT, index=False),
        T("bars rebalances", "SELECT as_of, symbol, momentum, rank FROM signals", signal_ctes(SHORT, EVERYONE)),
        "T02 P14",
    ),
    "momentum_ranks": Query(
        lambda s: momentum.ranked_candidates(evaluated(s, SHORT)),
        T(
            "bars universe",
            """SELECT as_of, symbol, momentum, ROW_NUMBER() OVER (PARTITION BY as_of ORDER BY momentum DESC, symbol) AS rank
               FROM judged WHERE disposition = 'eligible'""",
            signal_ctes(SHORT),
        ),
        "W03 T03",
    ),
    "dispositions": Query(
        lambda s: evaluated(s).select("as_of", "symbol", "disposition"),
        T("bars universe", "SELECT as_of, symbol, disposition FROM judged", signal_ctes(PARAMS)),
        "P15 P11 P12 P13",
    ),
    "filter_counts": Query(
        lambda s: momentum.filter_counts(evaluated(s), PARAMS),
        T(
            "bars universe",
            """SELECT as_of, COUNT(*) FILTER (WHERE disposition = 'insufficient_history') AS insufficient_history,
                 COUNT(*) FILTER (WHERE disposition = 'failed_price_filter') AS failed_price_filter,
                 COUNT(*) FILTER (WHERE disposition = 'failed_liquidity_filter') AS failed_liquidity_filter,
                 COUNT(*) FILTER (WHERE disposition = 'eligible') AS momentum_eligible,
                 LEAST(COUNT(*) FILTER (WHERE disposition = 'eligible'), 10) AS selected FROM judged GROUP BY as_of""",
            signal_ctes(PARAMS),
        ),
        "A05",
    ),
    "asof_join": Query(
        _asof,
        T(
            "bars trades",
            """SELECT t.order_id, t.position_key AS symbol, t.session AS on_day, b.session AS bar_session, CAST(b.close AS DOUBLE) AS bar_close, b.volume AS bar_volume
               FROM trades t ASOF LEFT JOIN bars b ON t.position_key = b.symbol AND t.session >= b.session""",
        ),
        "J29 P07",
    ),
    "stored_asof": Query(
        _asof_stored,
        T(
            "bars trades",
            """SELECT t.order_id, t.position_key AS symbol, t.session AS on_day, b.session AS bar_session, CAST(b.close AS DOUBLE) AS bar_close, b.volume AS bar_volume
               FROM trades t ASOF LEFT JOIN bars b ON t.position_key = b.symbol AND t.session >= b.session""",
        ),
        "J29 S05",
    ),
    "universe_slice": Query(
        _slice,
        T(
            "universe bars securities",
            """SELECT as_of, CASE WHEN symbol NOT IN (SELECT symbol FROM bars) THEN 'missing'
                                  WHEN symbol IN (SELECT 'S' || substr(seed_key, 5, 6) FROM securities WHERE status = 'DELISTED') THEN 'unusable'
                                  ELSE 'priced' END AS state, COUNT(*) AS members
               FROM universe GROUP BY 1, 2""",
        ),
        "P14 P18 J04 J05",
    ),
    "longest_history": Query(
        lambda s: momentum.longest_history(s.bars),
        T("bars", "SELECT MAX(n) AS bars FROM (SELECT COUNT(*) AS n FROM bars GROUP BY symbol) t"),
        "A02",
    ),
}
