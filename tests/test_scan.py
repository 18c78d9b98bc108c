from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pitlab.operators.scan import blocked_scan, in_blocks, linear_scan

SCHEMA = "k string, i long, a decimal(24,18), b decimal(28,10)"


def tape(seed, sizes):
    drawn = random.Random(seed)
    a = lambda: drawn.choice([Decimal(1), Decimal(0), Decimal("0.5"), Decimal("0.333333333333333333"), Decimal("-0.25"), Decimal("1.5")])
    return [(k, i, a(), Decimal(drawn.randint(-10**6, 10**6)) / 100) for k, n in sizes.items() for i in range(n)]


def plain(rows):
    x, out = {}, {}
    for k, i, a, b in sorted(rows):
        x[k] = a * x.get(k, Decimal(0)) + b
        out[k, i] = x[k]
    return out


@pytest.mark.parametrize("parts", ["1", "7"])
def test_scan_equals_a_loop_in_any_blocks(spark, parts):
    rows = tape(4, {"hot": 700, "one": 1, "two": 2, "c": 33})
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = plain(rows)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        blocks = in_blocks(df, ["k"], ["i"], "test")
        blocked = blocked_scan(blocks, ["k"], F.col("a"), F.col("b"), "x", before_as="was")
        got = {(r["k"], r["i"]): r for r in blocked.collect()}
        assert all(r["was"] == (got[k, i - 1]["x"] if i else 0) for (k, i), r in got.items())
        blocked = blocked.drop("was")
        one = linear_scan(df, ["k"], ["i"], F.col("a"), F.col("b"), "x")
        assert blocked.columns[-1] == one.columns[-1] == "x"
        for found in (blocked, one):
            got = {(r["k"], r["i"]): r["x"] for r in found.collect()}
            assert got.keys() == want.keys()
            assert max(abs(got[key] - want[key]) for key in want) < Decimal("0.0000001")
        assert blocks.where("k = 'hot'").select("_part").distinct().count() > 1 or parts == "1"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_starts_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1, Decimal(2), Decimal(1)), ("a", 2, Decimal(3), Decimal(0))], SCHEMA)
    got = linear_scan(df, ["k"], ["i"], F.col("a"), F.col("b"), "x", start=F.lit(5)).orderBy("i").collect()
    assert [r["x"] for r in got] == [11, 33]
    empty = df.limit(0)
    assert linear_scan(empty, ["k"], ["i"], F.col("a"), F.col("b"), "x").collect() == []
    assert blocked_scan(in_blocks(empty, ["k"], ["i"], "test"), ["k"], F.col("a"), F.col("b"), "x").collect() == []


def test_one_shuffle_and_no_python(spark):
    rows = tape(4, {"hot": 70})
    plan = linear_scan(spark.createDataFrame(rows, SCHEMA), ["k"], ["i"], F.col("a"), F.col("b"), "x")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1 and "Python" not in plan and "MapIn" not in plan
