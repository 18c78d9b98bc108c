"""What a replay gives and what it leaves out."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pytest

from pitlab.params import LedgerParams
from pitlab.plans import ledger as l
from pitlab.registry import execution
from pitlab.standins import frames

D = Decimal


@pytest.mark.parametrize("chunk", [100, 2])
def test_only_asked_columns_leave_the_fold(spark, chunk):
    rows = [(p, f"o{n}", "A", date(2020, 1, 1 + n), "SELL" if n == 3 else "BUY", 3, D("10.333333")) for p in (1, 2) for n in range(5)]
    orders = spark.createDataFrame(rows, "portfolio_id long, order_id string, position_key string, session date, side string, quantity long, market_price decimal(18,6)")
    params = LedgerParams(initial_cash=D(100))
    whole = l.replay_ledger(orders, params, chunk_rows=chunk)
    some = l.replay_ledger(orders, params, chunk_rows=chunk, columns=("sequence", "cash", "average_price", "outcome"))
    assert whole.columns == l.LEDGER.fieldNames()
    assert some.columns == ["portfolio_id", "cash", "average_price", "outcome", "sequence"]
    assert sorted(map(str, some.collect())) == sorted(map(str, whole.select(*some.columns).collect()))
    assert {r["outcome"] for r in some.collect()} == {None, "FLAT"}


def test_the_book_needs_no_written_tape(spark, tmp_path):
    lines = [  # order, line, part, supplier, quantity, price, tax, flag
        (1, 1, 5, 11, 3.0, 100.0, 0.05, "N"), (1, 2, 5, 21, 4.0, 200.0, 0.0, "N"), (2, 2, 5, 1, 1.0, 150.0, 0.02, "R"), (3, 1, 6, 2, 2.0, 60.0, 0.01, "R"),
    ]
    spark.createDataFrame(
        [(*x, datetime(1996, 1, x[0]), 0.05) for x in lines],
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_tax double, l_returnflag string, l_shipdate timestamp, l_discount double",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 7), (2, 7), (3, None)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    s = frames.Standins(spark, str(tmp_path))
    got = execution._book(s, "sequence", "status", "side")
    assert got.columns == ["portfolio_id", "sequence", "status", "side"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(None, 1, "REJECTED", "SELL"), (7, 1, "FILLED", "BUY"), (7, 2, "REJECTED", "BUY"), (7, 3, "REJECTED", "SELL")]))
    assert execution.ledger(s).count() == 4
    measures = {r["portfolio_id"]: (r["sessions"], r["final_equity"]) for r in execution._metrics(s).collect()}
    assert measures == {None: (1, 2000000.0), 7: (3, 1999899.85)}
    # Neither the tape nor the bars of names that nobody holds are written for them.
    assert {name for _, folder, name in frames._WRITTEN if folder == str(tmp_path)} <= {"calendar"}


def test_orders_of_a_portfolio_are_numbered_across_chunks(spark):
    rows = [(p, f"o{n}", "A", date(2020, 1, 1 + n // 3), "BUY", 1, D(1)) for p in (1, 2) for n in range(9)]
    for chunk in (100, 4):
        book = l.replay_ledger(spark.createDataFrame(rows, "portfolio_id long, order_id string, position_key string, session date, side string, quantity long, market_price decimal(18,6)"), LedgerParams(initial_cash=D(900)), chunk_rows=chunk)
        assert sorted((r["portfolio_id"], r["order_id"], r["sequence"]) for r in book.collect()) == [(p, f"o{n}", n + 1) for p in (1, 2) for n in range(9)]
        by_number = l.cash_history(book, ("session", "sequence")).collect()
        assert sorted(map(tuple, by_number), key=str) == sorted(map(tuple, l.cash_history(book).collect()), key=str) and len(by_number) == 6
