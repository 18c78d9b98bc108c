"""Imports shuffle a row once, and of stored bars the keys."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from pitlab.plans import imports
from pitlab.registry import bars as bar_queries

D = Decimal
DAY = date(2020, 1, 1)


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_imports_shuffle_a_row_once_and_stored_keys_only(spark):
    rows = "symbol string, ts timestamp, close decimal(18,6), volume long, source string, row_number long, issues array<string>, session date"
    at = lambda n: datetime(2020, 1, n, 14, 30)
    parsed = spark.createDataFrame(
        [("A", at(2), D(1), 1, "b", 1, [], date(2020, 1, 2)), ("A", at(2), D(2), 2, "a", 2, [], date(2020, 1, 2)), ("A", at(2), D(3), 3, "a", 1, ["bad"], date(2020, 1, 2)),
         ("A", at(3), D(4), 4, "a", 3, [], date(2020, 1, 3)), ("A", at(6), D(5), 5, None, 3, ["bad"], date(2020, 1, 6))], rows)
    stored = spark.createDataFrame([("A", at(3), date(2020, 1, 3))], "symbol string, ts timestamp, session date")
    asked = spark.createDataFrame([("A", DAY, date(2020, 12, 31))], "symbol string, start date, end date")
    fresh, summary = imports.import_bars(parsed, stored, asked)
    assert fresh.columns == [c for c in parsed.columns if c != "issues"]
    assert [tuple(r) for r in fresh.collect()] == [("A", at(2), D("2.000000"), 2, "a", 2, date(2020, 1, 2))]
    got = summary.first()
    assert (got["rows_read"], got["rows_inserted"], got["duplicates"], got["invalid_rows"], got["bars_stored"]) == (5, 1, 2, 2, 2)
    assert "min_by" not in plan(fresh)
    assert "stored-keys" in bar_queries._stock.__code__.co_consts
