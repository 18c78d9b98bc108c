from __future__ import annotations

from datetime import date, timedelta

import pytest
from conftest import ramp
from pyspark.sql import functions as F

from pitlab.operators.calendars import month_starts, rebalance_dates, trading_calendar
from pitlab.params import MomentumParams, ParameterError, warmup_bounds
from pitlab.plans import momentum as m

P = MomentumParams(lookback=5, skip=1, top_n=2, min_price=10, liquidity_window=2, min_dollar_volume=1000)


def at(spark, *days):
    return spark.createDataFrame([(date(2020, 1, 1) + timedelta(days=d),) for d in days], "as_of date")


def judge(bars, dates, params=P, universe=None):
    rows = m.evaluate(bars, trading_calendar(bars), dates, params, universe).collect()
    return {(r["symbol"], (r["as_of"] - date(2020, 1, 1)).days): r for r in rows}


def test_value_uses_own_bars_and_skip(make_bars, spark):
    bars = make_bars({"A": [(0, 50, 100, 50), (3, 60, 100, 60), (4, 70, 100, 66), (9, 80, 100, 90), (10, 90, 100, 99), (12, 95, 100, 1)]})
    row = judge(bars, at(spark, 12))[("A", 12)]
    assert row["momentum"] == pytest.approx(99 / 50 - 1)
    assert row["avg_dollar_volume"] == pytest.approx((90 * 100 + 95 * 100) / 2)


def test_missing_anchor_and_zero_anchor_count_nowhere(make_bars, spark):
    points = ramp(6)
    no_skip = [p if i != 4 else (p[0], p[1], p[2], None) for i, p in enumerate(points)]
    zero = [p if i != 0 else (p[0], p[1], p[2], 0) for i, p in enumerate(points)]
    bars = make_bars({"N": no_skip, "Z": zero, "OK": points})
    got = judge(bars, at(spark, 5))
    assert got[("N", 5)]["disposition"] == got[("Z", 5)]["disposition"] == "bad_anchor"
    counts = m.filter_counts(m.evaluate(bars, trading_calendar(bars), at(spark, 5), P), P).first()
    assert (counts["momentum_eligible"], counts["insufficient_history"], counts["failed_price_filter"]) == (1, 0, 0)


def test_chain_order_and_equal_thresholds(make_bars, spark):
    flat = [(i, 10, 100, 10 + i) for i in range(6)]
    cheap = [(i, 9.99, 10_000, 10 + i) for i in range(6)]
    thin = [(i, 20, 1, 10 + i) for i in range(6)]
    down = [(i, 20, 1000, 30 - i) for i in range(6)]
    bars = make_bars({"EQ": flat, "CHEAP": cheap, "THIN": thin, "DOWN": down, "NEW": ramp(3, first=3)})
    got = {k[0]: r["disposition"] for k, r in judge(bars, at(spark, 5)).items()}
    assert got == {
        "EQ": "eligible", "CHEAP": "failed_price_filter", "THIN": "failed_liquidity_filter",
        "DOWN": "non_positive_momentum", "NEW": "insufficient_history",
    }


def test_date_without_bar_uses_latest_earlier_one(make_bars, spark):
    bars = make_bars({"A": ramp(6), "B": ramp(20)})
    got = judge(bars, at(spark, 8, 15))
    assert got[("A", 8)]["n_bars"] == 6 and got[("A", 15)]["n_bars"] == 6
    assert got[("B", 8)]["n_bars"] == 9 and got[("B", 15)]["n_bars"] == 16


def test_dates_outside_the_calendar_are_answered(make_bars, spark):
    bars = make_bars({"A": ramp(6, first=2)})
    got = judge(bars, at(spark, 0, 100))
    assert got[("A", 0)]["disposition"] == "insufficient_history"
    assert got[("A", 100)]["n_bars"] == 6


def test_future_bars_change_nothing(make_bars, spark):
    past = {"A": ramp(10, step=2), "B": ramp(10, step=1)}
    future = {s: p + [(d + 10, 5000.0, 1, 0.01) for d in range(30)] for s, p in past.items()}
    now, later = (judge(make_bars(x), at(spark, 7, 9)) for x in (past, future))
    fields = ("momentum", "disposition", "n_bars", "avg_dollar_volume")
    assert {k: [r[f] for f in fields] for k, r in now.items()} == {k: [r[f] for f in fields] for k, r in later.items()}


def test_rank_ties_by_symbol_and_no_padding(make_bars, spark):
    bars = make_bars({"C": ramp(6), "A": ramp(6), "B": ramp(6, step=0.5)})
    judged = m.evaluate(bars, trading_calendar(bars), at(spark, 5), P)
    assert [(r["symbol"], r["rank"]) for r in m.momentum_signals(judged, P).orderBy("rank").collect()] == [("A", 1), ("C", 2)]
    ranks = m.ranked_candidates(judged).orderBy("rank").collect()
    assert [(r["symbol"], r["rank"]) for r in ranks] == [("A", 1), ("C", 2), ("B", 3)]
    wide = MomentumParams(lookback=5, skip=1, top_n=50, min_price=10, liquidity_window=2, min_dollar_volume=1000)
    assert m.momentum_signals(judged, wide).count() == 3


def test_universe_limits_and_members_without_bars_are_left_to_coverage(make_bars, spark):
    bars = make_bars({"A": ramp(6), "B": ramp(6)})
    universe = spark.createDataFrame([(date(2020, 1, 6), "B"), (date(2020, 1, 6), "GHOST")], "as_of date, symbol string")
    assert [k[0] for k in judge(bars, at(spark, 5), universe=universe)] == ["B"]


def test_session_duplicates_collapse_to_the_last_stamp(make_bars):
    bars = make_bars({"A": [(0, 10, 5, 10), (1, 11, 5, 11)]})
    later = bars.withColumn("ts", F.col("ts") + F.expr("interval 1 hour")).withColumn("close", F.col("close") + 1)
    rows = m.one_bar_per_session(bars.unionByName(later)).orderBy("session").collect()
    assert [float(r["close"]) for r in rows] == [11.0, 12.0]


def test_rebalance_dates(make_bars):
    bars = make_bars({"A": ramp(70)})
    cal = trading_calendar(bars)
    first = [r["as_of"] for r in rebalance_dates(cal).collect()]
    assert first == [date(2020, 1, 1), date(2020, 2, 1), date(2020, 3, 1)]
    warm = [r["as_of"] for r in rebalance_dates(cal, warmup_sessions=33).collect()]
    assert warm == [date(2020, 3, 1)]
    late = rebalance_dates(cal, signal_start=date(2020, 1, 15)).collect()
    assert [(r["as_of"], r["execution_session"]) for r in late][0] == (date(2020, 2, 1), date(2020, 2, 2))


def test_last_session_has_no_execution(make_bars):
    rows = rebalance_dates(trading_calendar(make_bars({"A": ramp(32)}))).collect()
    assert rows[-1]["as_of"] == date(2020, 2, 1) and rows[-1]["execution_session"] is None


def test_month_starts(spark):
    days = [r["as_of"] for r in month_starts(spark, date(2019, 11, 15), date(2020, 2, 1)).orderBy("as_of").collect()]
    assert days == [date(2019, 11, 15), date(2019, 12, 1), date(2020, 1, 1), date(2020, 2, 1)]
    assert month_starts(spark, date(2020, 1, 2), date(2020, 1, 1)).count() == 0


def test_history_gate(make_bars):
    bars = make_bars({"A": ramp(5), "B": ramp(3)})
    m.ensure_sufficient_history(bars, 4)
    with pytest.raises(ValueError, match="need 6 bars"):
        m.ensure_sufficient_history(bars, 5)


@pytest.mark.parametrize("bad", [{"skip": -1}, {"lookback": 21, "skip": 21}, {"top_n": 0}, {"min_price": -1}, {"liquidity_window": 0}])
def test_parameters(bad):
    with pytest.raises(ParameterError):
        MomentumParams(**bad)


def test_warmup_bounds():
    own = warmup_bounds(date(2015, 1, 1), date(2016, 1, 1), 252)
    assert (own.mode, own.warmup_sessions, own.performance_start) == ("in_window", 253, date(2015, 1, 1))
    assert own.warmup_start == date(2015, 1, 1) - timedelta(days=544)
    told = warmup_bounds(date(2015, 1, 1), date(2016, 1, 1), 252, date(2015, 6, 1))
    assert (told.mode, told.warmup_sessions, told.performance_start) == ("explicit_signal", 1, date(2015, 6, 1))
    with pytest.raises(ParameterError):
        warmup_bounds(date(2015, 1, 1), date(2016, 1, 1), 252, date(2014, 6, 1))
