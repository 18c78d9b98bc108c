"""Reads of stored tables: signals, orders, fills, snapshots, dimensions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlab.functions.dates import valid_at
from pitlab.operators.dedupe import latest_per_key
from pitlab.sources.sinks import write_by_date

# Order states in which an order may still trade, in the store and at the broker.
OPEN_STATUSES = ("CREATED", "VALIDATED", "SUBMITTED", "ACKNOWLEDGED", "PARTIALLY_FILLED")
CANCELLABLE = ("CREATED", "VALIDATED", "SUBMITTED")


def memberships_of(memberships: DataFrame, symbol: str | None = None) -> DataFrame:
    rows = memberships if symbol is None else memberships.filter(F.col("symbol") == symbol.strip().upper())
    return rows.orderBy("symbol", "start_date")


def members_on(memberships: DataFrame, as_of: date) -> DataFrame:
    return memberships.filter(valid_at(F.col("start_date"), F.col("end_date"), as_of))


def latest_bars(bars: DataFrame) -> DataFrame:
    """Last bar of every symbol at once."""
    return latest_per_key(bars, ["symbol"], ["session"])


def signals_on(signals: DataFrame, as_of: date) -> DataFrame:
    return signals.filter(F.col("as_of") == F.lit(as_of)).orderBy("rank")


def latest_signals(signals: DataFrame) -> DataFrame:
    """Signals of the last date; a table partitioned by as_of reads that partition only."""
    return signals.filter(F.col("as_of") == signals.agg(F.max("as_of")).scalar()).orderBy("rank")


def write_signals(signals: DataFrame, path: str) -> None:
    """A folder per date; a date that is written again replaces its signals."""
    write_by_date(signals, path, "as_of")


def order_state(log: DataFrame) -> DataFrame:
    """Current state of each order from its append-only status log."""
    return latest_per_key(log, ["client_order_id"], ["seq", "status"])


def open_orders(log: DataFrame, statuses: Sequence[str] = OPEN_STATUSES) -> DataFrame:
    return order_state(log).filter(F.col("status").isin(*statuses))


def status_of(asked: DataFrame, log: DataFrame) -> DataFrame:
    """Last status by id, FAILED for an id never seen."""
    last = order_state(log).select("client_order_id", "status")
    return asked.join(last, "client_order_id", "left").withColumn("status", F.coalesce("status", F.lit("FAILED")))


def cancel(log: DataFrame, requests: DataFrame) -> DataFrame:
    """Log rows that cancel the requested orders which can still be cancelled."""
    live = order_state(log).filter(F.col("status").isin(*CANCELLABLE))
    return (
        live.join(requests.select("client_order_id").distinct(), "client_order_id", "left_semi")
        .withColumn("seq", F.col("seq") + 1)
        .withColumn("status", F.lit("CANCELLED"))
        .select(*log.columns)
    )


def require_order(log: DataFrame, client_order_id: str) -> DataFrame:
    """One order by client id; raises if it is absent."""
    found = order_state(log.filter(F.col("client_order_id") == client_order_id))
    if found.isEmpty():
        raise LookupError(f"order {client_order_id} not found")
    return found


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """Last snapshot of each portfolio."""
    return latest_per_key(snapshots, ["portfolio_id"], ["session"])


def with_stock(rows: DataFrame, stocks: DataFrame) -> DataFrame:
    """Dimension join; Spark broadcasts the stocks while their size allows."""
    return rows.join(stocks, "symbol")


def missing_stocks(rows: DataFrame, stocks: DataFrame) -> DataFrame:
    """Symbols to add to the stock dimension."""
    return rows.select("symbol").distinct().join(stocks, "symbol", "left_anti")
