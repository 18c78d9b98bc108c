"""As-of joins: from any table, and from a bucketed one without a shuffle of its rows."""

from __future__ import annotations

import random
import re
import uuid
from datetime import date, timedelta

import pytest

from pitlab.operators.asof import asof_join, asof_stored
from pitlab.sources.bars import write_bucketed


def days_from(n):
    return date(2019, 12, 20) + timedelta(days=n)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(4)
    keys = ["hot"] * 6 + ["a", "b", "late"]
    bars = [(k, days_from(rng.randrange(400, 420) if k == "late" else rng.randrange(420)), rng.randrange(1000)) for k in rng.choices(keys, k=300)]
    bars += [(None, days_from(3), 1), ("a", None, 2), ("b", days_from(40), None), ("b", days_from(40), None)]
    asked = [(i, rng.choice([*keys, "never"]), days_from(rng.randrange(-5, 900))) for i in range(200)] + [(900, None, days_from(9)), (901, "a", None), (901, "a", None)]
    stored = spark.createDataFrame(bars, "symbol string, session date, v int")
    name = f"t_{uuid.uuid4().hex}"
    bucketed = write_bucketed(stored, name, str(tmp_path_factory.mktemp("stored") / name), 4)
    yield spark.createDataFrame(asked, "id long, symbol string, on_day date"), stored, bucketed
    spark.sql(f"DROP TABLE {name}")


def brute(asked, bars):
    out = []
    for q in asked:
        mine = [b for b in bars if b["symbol"] is not None and b["session"] is not None and q["on_day"] is not None and b["symbol"] == q["symbol"] and b["session"] <= q["on_day"]]
        best = max(mine, key=lambda b: (b["session"], -1 if b["v"] is None else b["v"]), default=None)
        out.append((*q, best and best["session"], best and best["v"]))
    return sorted(out, key=str)


def test_both_joins_equal_brute_force(tables):
    asked, stored, bucketed = tables
    want = brute(asked.collect(), stored.collect())
    for got in (asof_join(asked, stored.filter("session IS NOT NULL"), "symbol", "on_day", "session", prefix="b_"), asof_stored(asked, bucketed, "symbol", "on_day", "session", prefix="b_")):
        assert got.columns == ["id", "symbol", "on_day", "b_session", "b_v"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_no_rows_on_either_side(tables):
    asked, _, bucketed = tables
    assert asof_stored(asked.limit(0), bucketed, "symbol", "on_day", "session").count() == 0
    assert asof_stored(asked, bucketed.filter("false"), "symbol", "on_day", "session").filter("session IS NULL").count() == asked.count()


def test_stored_rows_are_not_shuffled(spark, tables):
    """Between a scan of the stored table and the last aggregation over it stands no exchange. No side is small enough to broadcast."""
    asked, _, bucketed = tables
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = asof_stored(asked, bucketed, "symbol", "on_day", "session")._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = text.splitlines()
    depth = [len(re.match(r"[\s:+\-|*()\d]*", x)[0]) for x in lines]
    scans = [i for i, x in enumerate(lines) if "FileScan parquet" in x and "Bucketed: true" in x]
    assert len(scans) == 2
    for i in scans:
        at, above = depth[i], []
        for j in range(i - 1, -1, -1):
            if depth[j] < at:
                at = depth[j]
                above.append(lines[j])
        first = next(k for k, x in enumerate(above) if "Aggregate" in x)
        # The partial aggregation and, still without an exchange, the final one (with a sort before it).
        assert "Aggregate" in above[first + 1] or "Sort" in above[first + 1], above[: first + 3]
        assert not any("Exchange" in x for x in above[: first + 2]), above[: first + 3]
