"""Gates over series: same verdicts without joins or second scans."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from pitlab.functions.checks import breaks, issues, strict_bar_rules
from pitlab.plans import vendor_checks as v

D = Decimal
DAY = date(2020, 1, 1)


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_adjustment_differs_without_a_join(spark):
    schema = "symbol string, session date, adjusted_close decimal(18,6), close decimal(18,6)"
    other = date(2020, 1, 2)
    adjusted = spark.createDataFrame(
        [("same", DAY, None, D(1)), ("same", DAY, D(1), D(9)), ("twice", DAY, D(1), D(1)), ("twice", DAY, D(2), D(2)), ("null", DAY, None, None), ("apart", DAY, D(1), D(1)),
         ("left", DAY, D(1), D(1)), (None, DAY, D(1), D(1)), ("day", None, D(1), D(1)), ("late", DAY, D(1), D(1)), ("late", other, D(3), D(3))], schema)
    raw = spark.createDataFrame(
        [("same", DAY, None, D(1)), ("twice", DAY, None, D(1)), ("null", DAY, None, D(1)), ("apart", other, None, D(2)),
         ("right", DAY, None, D(2)), (None, DAY, None, D(2)), ("day", None, None, D(2)), ("late", DAY, None, D(1)), ("late", other, None, D(2))], schema)
    made = v.adjustment_differs(adjusted, raw)
    assert "Join" not in plan(made)
    assert {r["symbol"]: r["differs"] for r in made.collect()} == {
        "same": False, "twice": True, "null": None, "apart": None, "left": None, "right": None, None: None, "day": None, "late": True
    }


def test_gates_of_one_row_are_one_scan(spark):
    schema = "symbol string, session date, open decimal(18,6), high decimal(18,6), low decimal(18,6), close decimal(18,6), adjusted_close decimal(18,6), volume long"
    bars = spark.createDataFrame(
        [("A", DAY, D(2), D(3), D(1), D(2), D(2), 1), ("B", DAY, D(2), D(3), D(0), D(2), D(2), 1), ("C", DAY, None, D(3), D(1), D(2), None, None), (None, DAY, D(2), D(3), D(1), D(2), D(2), 1),
         ("E", DAY, None, None, None, None, D(1), None)], schema)
    rules = strict_bar_rules()
    both = bars.select("symbol", (F.size(issues(rules)) > 0).alias("a"), breaks(rules).alias("b")).collect()
    assert [r["a"] for r in both] == [r["b"] for r in both] == [False, True, True, True, False]
    gates = v.series_gates(bars, bars)
    assert sorted((r["gate"], r["status"], r["n"]) for r in gates.collect()) == [("A1", "FAIL", 3), ("A2", "PARTIAL", 0), ("Q1", "FAIL", 3)]
    assert plan(gates).count("count(1)") <= 2
