"""Holdings and wanted names of the stand-ins."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from pitlab.standins import frames

D = Decimal


def test_positions_are_folded_without_the_tape(spark, tmp_path):
    lines = [  # order, line, part, supplier, quantity, price, tax, flag
        (1, 1, 5, 11, 3.0, 100.0, 0.05, "R"), (1, 2, 5, 21, 4.0, 200.0, 0.0, "R"), (1, 3, 5, 2, 1.0, 50.0, 0.02, "A"),
        (2, 1, 6, 2, 2.0, 60.0, 0.0, "N"), (3, 2, 6, 12, 2.0, 70.0, 0.0, "R"), (4, 1, 6, 3, 2.0, 70.0, 0.0, "A"), (9, 1, 6, 3, 2.0, 70.0, 0.1, "R"),
    ]
    spark.createDataFrame(
        [(*x, datetime(1996, 1, 1)) for x in lines],
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_tax double, l_returnflag string, l_shipdate timestamp",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, None)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    s = frames.Standins(spark, str(tmp_path))
    held = sorted(tuple(r) for r in s.holdings.collect())
    wanted = sorted(tuple(r) for r in s.wanted.select("portfolio_id", "symbol", "position_key").collect())
    assert held == [(7, "security:S000001", "S000001", 3, D("100.000000"), True), (8, "security:S000002", "S000002", 2, D("0.000000"), True)]
    assert wanted == [(7, "S000002", "security:S000002")]
    written = {name for _, folder, name in frames._WRITTEN if folder == str(tmp_path)}
    assert "orders" not in written
    tape = s.orders.filter("side = 'SELL'").groupBy("portfolio_id", "position_key").agg(F.sum("quantity")).collect()
    assert sorted((p, k, q) for p, k, q in tape) == [(p, symbol, q) for p, _, symbol, q, *_ in held]
