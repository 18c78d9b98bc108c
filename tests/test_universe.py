from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from pitlab.functions.text import strip_removal_suffix
from pitlab.operators.intervals import overlap_counts, snapshots_to_intervals
from pitlab.plans import audit as a
from pitlab.plans import universe as u
from pitlab.sources.universe import parse_snapshots, read_memberships, read_snapshots

M = "symbol string, start_date date, end_date date"


def d(text):
    return date.fromisoformat(text)


def frame(spark, rows):
    return spark.createDataFrame([(s, d(x), d(y) if y else None) for s, x, y in rows], M)


def dates(spark, *days):
    return spark.createDataFrame([(d(x),) for x in days], "as_of date")


def test_half_open_boundaries(spark):
    mem = frame(spark, [("A", "2020-01-10", "2020-02-10"), ("B", "2020-02-10", None)])
    got = {(str(r["as_of"]), r["symbol"]) for r in u.universe_as_of(mem, dates(spark, "2020-01-09", "2020-01-10", "2020-02-09", "2020-02-10", "2030-01-01")).collect()}
    assert got == {("2020-01-10", "A"), ("2020-02-09", "A"), ("2020-02-10", "B"), ("2030-01-01", "B")}


def test_snapshots_close_and_reopen(spark):
    snaps = [("2020-01-01", "A"), ("2020-01-01", "B"), ("2020-02-01", "B"), ("2020-03-01", "A"), ("2020-03-01", "B")]
    rows = snapshots_to_intervals(spark.createDataFrame([(d(x), s) for x, s in snaps], "change_date date, symbol string")).collect()
    got = sorted((r["symbol"], str(r["start_date"]), str(r["end_date"])) for r in rows)
    assert got == [("A", "2020-01-01", "2020-02-01"), ("A", "2020-03-01", "None"), ("B", "2020-01-01", "None")]


def test_changes_and_summary(spark):
    mem = frame(spark, [("A", "2020-01-01", "2020-02-01"), ("B", "2020-01-01", None), ("C", "2020-02-01", None)])
    days = dates(spark, "2020-01-01", "2020-02-01", "2020-03-01")
    rows = {(str(r["rebalance_date"]), r["symbol"]): r["eligibility_reason"] for r in u.universe_changes(mem, days).collect()}
    assert rows[("2020-01-01", "A")] == "joined" and rows[("2020-02-01", "A")] == "left_index"
    assert rows[("2020-02-01", "C")] == "joined" and rows[("2020-03-01", "B")] == "member"
    only = u.universe_changes(mem, days, changes_only=True).collect()
    assert {r["eligibility_reason"] for r in only} == {"joined", "left_index"}
    sizes = [(r["universe_size"], r["new_constituents"], r["removed_constituents"]) for r in u.universe_summary(mem, days).orderBy("rebalance_date").collect()]
    assert sizes == [(2, 2, 0), (2, 1, 1), (2, 0, 0)]


def brute_overlaps(rows):
    top = date(9999, 12, 31)
    kinds = sorted(set(rows), key=str)
    out = {}
    for k, s, e in kinds:
        if e is not None and s >= e:
            out[(k, s, e)] = 0
            continue
        out[(k, s, e)] = sum(
            1 for k2, s2, e2 in kinds
            if k2 == k and (s2, e2) != (s, e) and not (e2 is not None and s2 >= e2) and s < (e2 or top) and s2 < (e or top)
        )
    return out


def test_overlap_sweep_equals_pairwise(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(400):
        # One key holds most of the rows.
        key = "HOT" if rng.random() < 0.6 else rng.choice("XYZ")
        s = date(2020, 1, 1) + timedelta(days=rng.randrange(200))
        e = None if rng.random() < 0.05 else s + timedelta(days=rng.randrange(-2, 15))
        rows += [(key, s, e)] * rng.choice([1, 1, 2])
    got = overlap_counts(spark.createDataFrame(rows, M), ["symbol"], "start_date", "end_date").collect()
    assert {(r["symbol"], r["start_date"], r["end_date"]): r["overlap_count"] for r in got} == brute_overlaps(rows)
    assert sum(r["copies"] for r in got) == len(rows)


def test_adjacent_intervals_are_fine_and_copies_do_not_block(spark):
    ok = frame(spark, [("A", "2020-01-01", "2020-02-01"), ("A", "2020-02-01", None), ("A", "2020-02-01", None)])
    rows, allowed = u.persistable(ok)
    assert allowed and rows.count() == 2
    assert not u.persistable(frame(spark, [("A", "2020-01-01", "2020-03-01"), ("A", "2020-02-01", None)]))[1]
    assert not u.persistable(frame(spark, [("A", "2020-03-01", "2020-03-01")]))[1]


def test_leakage(spark):
    mem = frame(spark, [("LATE", "2021-01-01", None), ("BACK", "2019-01-01", "2020-06-01"), ("BACK", "2021-01-01", None), ("IN", "2019-01-01", None)])
    chosen = spark.createDataFrame([(d("2020-01-01"), s) for s in ("LATE", "BACK", "IN")], "as_of date, symbol string")
    assert [r["symbol"] for r in u.future_leakage(chosen, mem).collect()] == ["LATE"]


def test_slice_never_drops(spark, make_bars):
    uni = spark.createDataFrame([(d("2020-01-01"), s) for s in ("A", "B", "C")], "as_of date, symbol string")
    bars = make_bars({"A": [(0, 1, 1, 1)], "B": [(0, 1, 1, 1)]})
    bad = spark.createDataFrame([("B", "mismatch"), ("C", "mismatch")], "symbol string, reason string")
    got = {r["symbol"]: r["state"] for r in u.universe_slice(uni, bars, bad).collect()}
    assert got == {"A": "priced", "B": "unusable", "C": "missing"}


def test_symbol_normalisation(spark):
    rows = spark.createDataFrame([(" aal-199702 ",), ("brk.b",), ("-199702",), ("AB-12345",)], "s string")
    assert [r[0] for r in rows.select(strip_removal_suffix("s")).collect()] == ["AAL", "BRK.B", "-199702", "AB-12345"]


def test_snapshot_files(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text('﻿date,tickers\n2020-01-01,"A,b-202001, \'C\'"\n02/01/2020,"A,A"\n03-01-2020,"A,B"\n', encoding="utf-8")
    rows = {(str(r["change_date"]), r["symbol"]) for r in read_snapshots(spark, str(good)).collect()}
    assert rows == {("2020-01-01", "A"), ("2020-01-01", "B"), ("2020-01-01", "C"), ("2020-02-01", "A"), ("2020-03-01", "A"), ("2020-03-01", "B")}
    mem = read_memberships(spark, str(good))
    assert mem.count() == 4 and len(mem.first()["source_version"]) == 64


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("date,tickers\n2020-01-01,A\n2020-01-01,B\n", "duplicate snapshot date"),
        ("date,tickers\n2020-01-01,\n", "empty ticker list"),
        ("date,tickers\nyesterday,A\n", "invalid or missing snapshot date"),
        ("date,tickers\n", "no rows"),
        ("day,tickers\n2020-01-01,A\n", "missing required columns date"),
    ],
)
def test_snapshot_file_errors(spark, tmp_path, text, message):
    path = tmp_path / "bad.csv"
    path.write_text(text)
    with pytest.raises(Exception, match=message):
        read_snapshots(spark, str(path)).collect()


def test_source_precedence(spark):
    f = lambda *names: spark.createDataFrame([(n,) for n in names], "symbol string")
    assert [r[0] for r in u.resolve_universe(f(" x "), f("y"), f("z")).collect()] == ["X"]
    assert [r[0] for r in u.resolve_universe(f(" "), None, f("z")).collect()] == ["Z"]


def test_audit_flags(spark, make_bars):
    mem = frame(spark, [("OLD", "2018-01-01", None), ("GONE", "2018-01-01", None), ("OK", "2021-12-01", None), ("SFX-202001", "2022-01-01", None)]).withColumn("source", F.lit("src"))
    from pitlab.plans.quality import price_windows

    bars = make_bars({"OLD": [(800, 1, 1, 1), (1500, 1, 1, 1)], "GONE": [(0, 1, 1, 1), (10, 1, 1, 1)], "OK": [(700, 1, 1, 1), (1500, 1, 1, 1)]})
    days = dates(spark, "2022-06-01")
    flags = a.symbol_flags(mem, price_windows(bars), days)
    got = {r["symbol"]: (r["late_price_start"], r["after_prices"], r["suspicious"]) for r in flags.collect()}
    assert got["OLD"] == (True, False, True) and got["GONE"] == (False, True, True) and got["OK"] == (False, False, False)
    kinds = {r["symbol"]: r["class"] for r in a.classify_symbols(flags, mem, price_windows(bars), days).collect()}
    assert kinds == {"OLD": "f", "GONE": "f", "OK": "a", "SFX-202001": "c"}


def test_parse_snapshots_needs_columns(spark):
    with pytest.raises(ValueError, match="missing required columns"):
        parse_snapshots(spark.createDataFrame([("x",)], "date string"))


def test_universe_as_of_takes_the_earliest_interval_without_a_shuffle_of_members(spark):
    random.seed(5)
    day = lambda k: None if k is None else date(2020, 1, 1) + timedelta(days=k)
    rows = [("A", 0, 40), ("A", 0, None), ("A", 10, 20), ("B", 5, 5), ("B", 9, 3), ("B", 7, 30), ("B", 7, 30), ("B", 2, 12), ("C", None, 8), ("C", 3, 50), (None, 1, 9), (None, 4, 60), ("D", None, None)]
    rows += [(random.choice("EFG"), random.choice([None, *range(90)]), random.choice([None, *range(90)])) for _ in range(60)]
    members = spark.createDataFrame([(s, day(a), day(b)) for s, a, b in rows], "symbol string, start_date date, end_date date")
    days = [0, 1, 5, 8, 9, 15, 31, 32, 45, 59, 60, 88, 120]
    dates = spark.createDataFrame([(day(k),) for k in [*days, 5]], "as_of date")
    want = set()
    for k in days:
        for symbol in {r[0] for r in rows}:
            inside = [(a, b) for s, a, b in rows if s == symbol and (a is None or a <= k) and (b is None or k < b) and not (a is not None and b is not None and a >= b)]
            if inside:
                a, b = min(inside, key=lambda i: (i[0] is not None, i[0] or 0, i[1] is not None, i[1] or 0))
                want.add((day(k), symbol, day(a), day(b)))
    made = u.universe_as_of(members, dates)
    found = list(map(tuple, made.collect()))
    assert len(found) == len(want) and set(found) == want
    text = made._jdf.queryExecution().executedPlan().toString()
    assert "as_of" not in "".join(line for line in text.splitlines() if "hashpartitioning" in line and "symbol" in line)
    assert "SortAggregate" not in text
