"""Equity of position spans."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pitlab.operators.calendars import trading_calendar
from pitlab.params import LedgerParams
from pitlab.plans import ledger as l

D = Decimal


def test_equity_needs_no_ends_of_cash(spark):
    days = [date(2020, 1, n) for n in (1, 2, 3, 6)]
    orders = spark.createDataFrame(
        [(1, "a", "A", days[0], "BUY", 2, D(10)), (1, "b", "A", days[2], "SELL", 1, D(12)), (2, "c", "A", days[1], "BUY", 1, D(11))],
        "portfolio_id long, order_id string, position_key string, session date, side string, quantity long, market_price decimal(18,6)",
    )
    bars = spark.createDataFrame([("A", d, D(10 + n)) for n, d in enumerate(days)], "symbol string, session date, close decimal(18,6)")
    calendar = trading_calendar(bars)
    book = l.replay_ledger(orders, LedgerParams(initial_cash=D(100)))
    positions, cash = l.position_history(book), l.cash_history(book)
    want = sorted(tuple(r) for r in l.nav(l.mark_positions(positions, bars, calendar), cash, calendar).select("portfolio_id", "session", "cash", "equity").collect())
    made = l.equity_of_positions(positions, cash.drop("end_date"), bars, calendar)
    assert sorted(tuple(r) for r in made.select("portfolio_id", "session", "cash", "equity").collect()) == want and len(want) == 7
