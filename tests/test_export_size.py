"""Exports written as gzipped CSV."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from pitlab.sources import sinks


def size(folder: Path, ending: str) -> int:
    found = [p for p in folder.rglob("part-*")]
    assert found and all(p.name.endswith(ending) for p in found)
    return sum(p.stat().st_size for p in found)


def test_gzipped_exports_hold_the_same_rows(spark, tmp_path):
    text = lambda c: F.lit(c).cast("string")
    rows = spark.range(4000).select(
        F.timestamp_seconds(F.col("id") * 86400).alias("timestamp"), F.when(F.col("id") % 7 > 0, "A, \"b\"").alias("symbol"), F.col("id").alias("quantity"),
        *[(F.col("id") / 7).cast("decimal(18,6)").alias(c) for c in ("market_price", "price", "commission", "slippage")],
        F.concat(F.lit("o"), F.col("id")).alias("order_id"), *[text(None).alias(c) for c in ("portfolio_value", "cash", "position_quantity", "security_id", "listing_id")], text("k").alias("position_key"),
    )
    book = rows.filter("quantity % 3 > 0").select(
        F.col("order_id").alias("client_order_id"), "symbol", F.lit("BUY").alias("side"), "quantity", F.lit("MARKET").alias("order_type"), F.lit("FILLED").alias("status"),
        F.col("price").alias("limit_price"), "security_id", "listing_id", "position_key",
    )
    equity = rows.select(F.to_date("timestamp").alias("session"), *[F.col("price").alias(c) for c in ("equity", "cash", "returns", "drawdown")])
    sinks.write_backtest_export(rows, book, equity, str(tmp_path / "plain"))
    sinks.write_backtest_export(rows, book, equity, str(tmp_path / "small"), "gzip")
    for name in ("fills", "orders", "equity"):
        one, other = (sorted(map(str, spark.read.csv(str(tmp_path / kind / name), header=True).collect())) for kind in ("plain", "small"))
        assert one == other and len(one) >= 2666
        assert size(tmp_path / "small" / name, ".csv.gz") * 2 < size(tmp_path / "plain" / name, ".csv")


def test_the_query_writes_gzipped_files(spark, tmp_path):
    from datetime import datetime

    from pitlab.registry import all_queries
    from pitlab.session import shared_folder
    from pitlab.standins.frames import Standins

    lines = [(o, n, 5, 11, 3.0, 100.0 + n, 0.05, "R" if n > 1 else "N", datetime(1996, 1, n)) for o in (1, 2) for n in (1, 2, 3)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_tax double, l_returnflag string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 7), (2, 7)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(7, 3)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    exports = lambda: {p for p in Path(shared_folder(spark).removeprefix("file:")).glob("pitlab/export-*")}
    before = exports()
    got = sorted(tuple(r) for r in all_queries()["export_files"].build(Standins(spark, str(tmp_path))).select("symbol", "side", "fills", "quantity", "equity_days").collect())
    assert got == [("S000011", "", 1, 10, 3), ("S000011", "BUY", 2, 2, 3), ("S000011", "SELL", 4, 10, 3)]
    (folder,) = exports() - before
    for name in ("fills", "orders", "equity"):
        size(folder / name, ".csv.gz")
