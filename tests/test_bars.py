from __future__ import annotations

import shutil
from datetime import date

import pytest
from conftest import ramp
from pyspark.sql import functions as F

from pitlab.functions.checks import issues, table_rules
from pitlab.operators.dedupe import merge_bars, upsert_bars
from pitlab.params import ParameterError, minimum_expected_bars
from pitlab.plans import imports, quality
from pitlab.schemas import BARS
from pitlab.sources import bars as b
from pitlab.sources.vendor import normalize_vendor_bars
from pitlab.streaming.bars import ingest, read_raw_stream, valid_bars, without_repeats

HEAD = "symbol,timestamp,open,high,low,close,adjusted_close,volume\n"


def write(path, *lines, head=HEAD, bom=False):
    path.write_text(("﻿" if bom else "") + head + "\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


GOOD = "ibm,2020-01-02T14:30:00Z,10,12,9,11,10.5,100"


def test_strict_scan(spark, tmp_path):
    path = write(
        tmp_path / "ibm_daily.csv", GOOD, GOOD.replace(",11,", ",11.5,"), "IBM,2020-01-03T09:30:00-05:00,10,12,9,11,,100",
        "IBM,2020-01-04T14:30:00Z,10,8,9,11,10,-5", "IBM,2020-01-05T14:30:00,10,12,9,11,10,5", "OTHER,2020-01-02T14:30:00Z,1,1,1,1,1,1", bom=True,
    )
    bars, rejects, counts = b.read_bars_csv(spark, path, ["ibm"], date(2020, 1, 1), date(2020, 1, 31))
    got = [(str(r["ts"]), float(r["close"]), r["adjusted_close"]) for r in bars.orderBy("ts").collect()]
    assert got[0][1] == 11.0 and len(got) == 2
    assert got[1][0] == "2020-01-03 14:30:00" and got[1][2] is None
    bad = {r["session"].day: r["issues"] for r in rejects.collect()}
    assert set(bad[4]) == {"high must be >= low", "high must be >= open", "high must be >= close", "volume must be non-negative"}
    assert bad[5] == ["timestamp must be timezone-aware"]
    assert "symbol=IBM" in rejects.first()["messages"][0] and "row=" in rejects.first()["messages"][0]
    row = counts.first()
    assert (row["rows_read"], row["invalid_rows"], row["duplicates"]) == (5, 2, 1)


@pytest.mark.parametrize("line", ["IBM,2020-01-02T14:30:00Z,ten,12,9,11,10,100", "IBM,soon,10,12,9,11,10,100", "IBM,2020-01-02T14:30:00Z,10,12,9,11,10,1.5"])
def test_unreadable_cells_are_fatal(spark, tmp_path, line):
    path = write(tmp_path / "x.csv", line)
    with pytest.raises(Exception, match="cannot read"):
        b.read_bars_csv(spark, path)[0].collect()
    assert b.read_bars_lenient(spark, path).count() == 0


def test_header_and_range_errors(spark, tmp_path):
    path = write(tmp_path / "x.csv", "IBM,1", head="symbol,close\n")
    with pytest.raises(ValueError, match="missing required columns"):
        b.read_bars_csv(spark, path)
    with pytest.raises(ParameterError):
        b.read_bars_csv(spark, path, start=date(2020, 2, 1), end=date(2020, 1, 1))
    with pytest.raises(ParameterError):
        b.read_bars(spark, path, "carrier-pigeon")


def test_discovery_and_resolution(spark, tmp_path):
    write(tmp_path / "ibm_daily.csv", GOOD)
    write(tmp_path / "MSFT.csv", GOOD.replace("ibm", "MSFT"))
    write(tmp_path / "memberships.csv", GOOD)
    write(tmp_path / "notes.csv", "a,b", head="x,y\n")
    assert {r[0] for r in b.discover_symbols(spark, str(tmp_path)).collect()} == {"IBM", "MSFT"}
    one = tmp_path / "one"
    one.mkdir()
    shutil.copy(tmp_path / "ibm_daily.csv", one / "Ibm_Daily.csv")
    assert b.read_symbol_files(spark, str(one), "IBM").count() == 1


def test_write_and_read_back(spark, tmp_path, make_bars):
    bars = make_bars({"B": [(0, 1.5, 5, None)], "A": [(1, 2, 6, 2), (0, 3, 7, 3)]})
    b.write_bars(bars, str(tmp_path / "csv"), "csv")
    back = b.read_bars(spark, str(tmp_path / "csv"), "csv")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, bars.collect()))
    b.write_bars(bars, str(tmp_path / "pq"))
    assert b.read_bars(spark, str(tmp_path / "pq")).count() == 3


def test_merge_prefers_the_earlier_group(make_bars):
    old, new = make_bars({"A": [(0, 1, 1, 1)]}), make_bars({"A": [(0, 2, 2, 2), (1, 3, 3, 3)]})
    assert [float(r["close"]) for r in merge_bars(old, new).orderBy("ts").collect()] == [1.0, 3.0]


def test_append_is_idempotent(make_bars):
    old = make_bars({"A": [(0, 1, 1, 1)]})
    new = make_bars({"A": [(0, 2, 2, 2), (1, 3, 3, 3), (1, 4, 4, 4)]})
    fresh, counts = upsert_bars(old, new, ["close"])
    assert [(float(r["close"]),) for r in fresh.collect()] == [(3.0,)]
    row = counts.first()
    assert (row["rows_read"], row["inserted"], row["duplicates"]) == (3, 1, 2)
    assert upsert_bars(old.unionByName(fresh), new, ["close"])[0].count() == 0


def test_quality_counts(make_bars):
    bars = make_bars({"A": [(0, 1, 1, 1), (0, 1, 1, 1), (5, 0, 1, 1), (11, 1, 0, None)], "B": [(0, 1, 1, 1)]})
    rows = {r["level"]: r for r in quality.bar_quality(bars).collect()}
    a, total = rows["A"], rows["total"]
    assert (a["bar_count"], a["duplicates"], a["missing_adjusted_close"], a["non_positive_price"], a["non_positive_volume"], a["suspicious_gaps"]) == (4, 1, 1, 1, 1, 1)
    assert total["bar_count"] == 5 and total["suspicious_gaps"] == 1
    assert quality.bar_gaps(bars, 6).count() == 0


def test_coverage_totals(spark, make_bars):
    bars = make_bars({"A": [(i, 1, 1, 1) for i in range(60)], "B": [(30, 1, 1, None)]})
    asked = spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string")
    rows = {r["level"]: r for r in quality.market_data_coverage(asked, bars, date(2020, 1, 1), date(2020, 2, 28), 50).collect()}
    t = rows["total"]
    assert (t["symbols"], t["with_prices"], t["without_prices"], t["incomplete_range"], t["insufficient_history"]) == (3, 2, 1, 1, 1)
    assert rows["C"]["download_status"] == "missing" and rows["B"]["missing_adjusted_close"] == 1


def test_no_series_is_unusable_by_default(make_bars):
    bars = make_bars({"A": [(0, 99999, 1, 1)]})
    assert quality.unusable_symbols(bars).count() == 0
    assert quality.unusable_symbols(bars, [(F.col("first_close") > 1000, "extreme")]).first()["reason"] == "extreme"


def raw_rows(spark, *rows):
    names = "symbol string, timestamp string, open string, high string, low string, close string, adjusted_close string, volume string, source string, row_number long"
    return b.parse_bars(spark.createDataFrame([(s, t, "1", "1", "1", "1", "1", v, "f", i) for i, (s, t, v) in enumerate(rows)], names), fatal=False)


def test_import_states(spark, make_bars):
    req = spark.createDataFrame([(s, date(2020, 1, 1), date(2020, 1, 20)) for s in ("HAVE", "NEW", "BAD", "NONE", "DUP")], "symbol string, start date, end date")
    old = make_bars({"HAVE": [(0, 1, 1, 1), (15, 1, 1, 1)]})
    rows = raw_rows(
        spark, ("HAVE", "2020-01-05T14:30:00Z", "1"), ("NEW", "2020-01-05T14:30:00Z", "1"), ("BAD", "2020-01-05T14:30:00Z", "-1"),
        ("DUP", "2020-01-05T14:30:00Z", "1"), ("DUP", "2020-01-05T14:30:00Z", "2"), ("NEW", "2021-01-05T14:30:00Z", "1"),
    )
    fresh, summary = imports.import_bars(rows, old, req)
    got = {r["symbol"]: (r["status"], r["origin"], r["rows_read"], r["rows_inserted"], r["duplicates"]) for r in summary.collect()}
    assert got["HAVE"] == ("SUCCESS", "DATABASE", 0, 0, 2)
    assert got["NEW"] == ("SUCCESS", "DOWNLOADED", 1, 1, 0)
    assert got["BAD"] == ("FAILED", "FAILED", 1, 0, 0)
    assert got["NONE"] == ("EMPTY", "EMPTY", 0, 0, 0)
    assert got["DUP"] == ("SUCCESS_WITH_WARNINGS", "DOWNLOADED", 2, 1, 1)
    assert fresh.count() == 2
    total = imports.import_report(summary).first()
    assert (total["symbols"], total["downloaded"], total["already_stored"], total["failed"], total["empty"]) == (5, 2, 1, 1, 1)


def test_long_ranges_need_enough_bars(spark, make_bars):
    req = spark.createDataFrame([("A", date(2020, 1, 1), date(2022, 1, 1))], "symbol string, start date, end date")
    rows = raw_rows(spark, ("A", "2020-01-05T14:30:00Z", "1"))
    empty = make_bars({"Z": [(0, 1, 1, 1)]})
    assert imports.import_bars(rows, empty, req, strict=True)[1].first()["status"] == "FAILED"
    assert imports.import_bars(rows, empty, req, strict=False)[1].first()["status"] == "SUCCESS_WITH_WARNINGS"
    assert [minimum_expected_bars(n) for n in (364, 365, 1000)] == [0, 252, 500]


def test_import_plan(spark, make_bars):
    windows = quality.price_windows(make_bars({"NEAR": [(5, 1, 1, 1)], "FAR": [(40, 1, 1, 1)]}))
    req = spark.createDataFrame([(s, date(2020, 1, 1), date(2020, 3, 1)) for s in ("NEAR", "FAR", "NONE")], "symbol string, start date, end date")
    got = {r["symbol"]: (r["action"], str(r["fetch_end"])) for r in imports.import_plan(windows, req).collect()}
    assert got == {"NEAR": ("cached", "None"), "FAR": ("prefix", "2020-02-09"), "NONE": ("full", "2020-03-01")}


def test_vendor_records(spark):
    raw = spark.createDataFrame(
        [("a", "2020-01-02", None, "12", "", "11", "7.9"), ("a", "2020-01-03", "1", "1", "1", None, "5"), ("a", None, "1", "1", "1", "1", "5"), ("a", "2020-01-05", "1", "2", "1", "2", "nan")],
        "symbol string, Date string, Open string, High string, Low string, Close string, Volume string",
    )
    rows = normalize_vendor_bars(raw, adjusted=False).orderBy("session").collect()
    assert [(float(r["open"]), float(r["high"]), float(r["low"]), r["adjusted_close"], r["volume"]) for r in rows] == [(11.0, 12.0, 11.0, None, 7), (1.0, 2.0, 1.0, None, 0)]


def test_raw_rows(spark):
    raw = spark.createDataFrame(
        [("a", "2020-01-02", "1", "2", "1", "2", "2", "5"), ("a", "2020-01-03", "NaN", "2", "1", "2", "2", "5"), ("a", "2020-01-04", "1", "2", "1", "2", "", "5"), ("a", "2020-01-05", "1", "2", "1", "2", "2", "5.5")],
        "symbol string, date string, open string, high string, low string, close string, adjusted_close string, volume string",
    )
    got = {r["session"].day: r["issues"] for r in b.normalize_raw_rows(raw).collect()}
    assert got[2] == [] and got[3] == got[5] == ["unparseable row"] and got[4] == ["adjusted_close is required"]


def test_every_table_has_rules(spark):
    row = spark.createDataFrame([("o", "", "BUY", 0, "LIMIT", None, "NEW")], "order_id string, symbol string, side string, quantity long, order_type string, limit_price double, status string")
    found = row.select(issues(table_rules("orders"))).first()[0]
    assert found == ["symbol must not be empty", "quantity must be > 0", "LIMIT order requires limit_price", "unknown status"]
    with pytest.raises(ValueError):
        table_rules("rockets")


def test_stream_matches_batch(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "table")
    folder.mkdir()
    write(folder / "a.csv", GOOD, GOOD, "IBM,2020-01-03T14:30:00Z,10,8,9,11,10,5")
    raw = read_raw_stream(spark, str(folder))
    ingest(raw, table, str(tmp_path / "ckpt"), once=True).awaitTermination(120)
    write(folder / "b.csv", GOOD, "IBM,2020-01-06T14:30:00Z,10,12,9,11,10,5")
    ingest(raw, table, str(tmp_path / "ckpt"), once=True).awaitTermination(120)
    stored = spark.read.parquet(table)
    assert [r["session"].day for r in stored.orderBy("session").collect()] == [2, 6]
    assert set(BARS.fieldNames()) <= set(stored.columns)


def test_stream_keeps_a_late_backfill(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "table")
    folder.mkdir()
    write(folder / "a.csv", "IBM,2025-12-01T14:30:00Z,10,12,9,11,10,5")
    raw = read_raw_stream(spark, str(folder))
    ingest(raw, table, str(tmp_path / "ckpt"), once=True).awaitTermination(120)
    write(folder / "b.csv", *(f"OLD,{year}-01-06T14:30:00Z,10,12,9,11,10,5" for year in range(2015, 2025)))
    ingest(raw, table, str(tmp_path / "ckpt"), once=True).awaitTermination(120)
    assert spark.read.parquet(table).count() == 11


def test_stream_forgets_repeats_without_a_look_at_the_table(spark, tmp_path):
    """A file delivered again reaches the append as no row; a bar of ten years ago and another value of a known stamp do reach it."""
    folder = tmp_path / "in"
    folder.mkdir()
    batches = []

    def run():
        rows = without_repeats(valid_bars(read_raw_stream(spark, str(folder))))
        query = rows.writeStream.option("checkpointLocation", str(tmp_path / "ckpt")).foreachBatch(lambda batch, _: batches.append(sorted(float(r["close"]) for r in batch.collect())))
        query.trigger(availableNow=True).start().awaitTermination(120)

    write(folder / "a.csv", GOOD, GOOD, "IBM,2020-01-03T14:30:00Z,10,12,9,11,10,5")
    run()
    write(folder / "b.csv", GOOD, "IBM,2020-01-03T14:30:00Z,10,12,9,11,10,5")
    run()
    write(folder / "c.csv", "IBM,2010-01-04T14:30:00Z,10,12,9,10,10,5", GOOD.replace(",11,", ",11.5,"))
    run()
    assert [b for b in batches if b] == [[11.0, 11.0], [10.0, 11.5]]


def test_import_counts_what_it_writes(spark, tmp_path, make_bars):
    req = spark.createDataFrame([(s, date(2020, 1, 1), date(2020, 1, 20)) for s in ("HAVE", "NEW", "NONE")], "symbol string, start date, end date")
    old = make_bars({"HAVE": [(0, 1, 1, 1), (15, 1, 1, 1)]})
    rows = raw_rows(spark, ("HAVE", "2020-01-05T14:30:00Z", "1"), ("NEW", "2020-01-05T14:30:00Z", "1"), ("NEW", "2020-01-05T14:30:00Z", "2"), ("NEW", "2020-01-09T14:30:00Z", "1"), ("NEW", "2020-01-06T14:30:00Z", "-1"))
    path = str(tmp_path / "bars")
    summary, seen = imports.store_import(rows, old, req, path)
    lazily = imports.import_bars(rows, old, req)
    assert seen == {"bars": 2, "first_session": date(2020, 1, 5), "last_session": date(2020, 1, 9)}
    assert sorted(map(tuple, summary.collect())) == sorted(map(tuple, lazily[1].collect()))
    assert sorted(map(str, spark.read.parquet(path).collect())) == sorted(map(str, lazily[0].collect()))


def test_csv_columns_are_read_by_name_per_file(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("symbol,timestamp,open,high,low,close,adjusted_close,volume\nIBM,2020-01-02T14:30:00Z,10,12,9,11,10,100.0\n")
    (folder / "b.csv").write_text("\ufeffVolume, low ,high,open,close,note,adjusted_close,timestamp,symbol\n7,1,4,2,3,\"x,y\",,2020-01-03T14:30:00Z,msft\n-1,1,4,2,3,z,,2020-01-04T14:30:00Z,msft\n")
    bars, rejects, counts = b.read_bars_csv(spark, str(folder))
    got = {r["symbol"]: (float(r["open"]), float(r["high"]), float(r["low"]), float(r["close"]), r["volume"]) for r in bars.collect()}
    assert got == {"IBM": (10.0, 12.0, 9.0, 11.0, 100), "MSFT": (2.0, 4.0, 1.0, 3.0, 7)}
    (bad,) = rejects.collect()
    assert bad["row_number"] == 3 and "row=3 symbol=MSFT" in bad["messages"][0]
    (folder / "c.csv").write_text("symbol,timestamp\nA,2020-01-02T14:30:00Z\n")
    with pytest.raises(Exception, match="missing required columns"):
        b.read_bars_csv(spark, str(folder))


def test_volume_with_a_fraction_is_no_number(spark, tmp_path):
    path = tmp_path / "a.csv"
    write(path, "IBM,2020-01-02T14:30:00Z,10,12,9,11,10,5.5")
    assert b.read_bars_lenient(spark, str(path)).count() == 0
    with pytest.raises(Exception, match="cannot read volume"):
        b.read_bars_csv(spark, str(path))[0].collect()


def test_symbol_file_is_the_first_match(spark, tmp_path):
    write(tmp_path / "IBM.csv", "IBM,2020-01-02T14:30:00Z,10,12,9,11,10,5")
    write(tmp_path / "ibm_daily.csv", "IBM,2020-01-03T14:30:00Z,10,12,9,11,10,5", "IBM,2020-01-04T14:30:00Z,10,12,9,11,10,5")
    assert b.read_symbol_files(spark, str(tmp_path), "ibm").count() == 1
    with pytest.raises(Exception, match="no bar file"):
        b.read_symbol_files(spark, str(tmp_path), "NONE")


def test_extents_come_from_footers(spark, make_bars, tmp_path):
    bars = make_bars({"A": ramp(40), "B/1": ramp(3, first=7), "007": ramp(1)})
    bars = bars.unionByName(bars.filter("symbol = 'A'").withColumn("symbol", F.lit(None).cast("string")))
    b.write_by_symbol(bars, str(tmp_path / "store"))
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    found = b.stored_extents(spark, str(tmp_path / "store"))
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MIN(session), MAX(session), COUNT(*)]" in text and "PushedGroupBy: [symbol]" in text
    want = quality.price_windows(bars).select("symbol", "first_date", "last_date", "bars")
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and found.count() == 4
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
    # Frames of both sessions can be joined.
    assert bars.join(found, "symbol").count() == 44


def test_extents_of_many_symbols_take_few_tasks(spark, tmp_path):
    day = F.date_add(F.lit(date(2020, 1, 1)), (F.col("id") % 3).cast("int"))
    bars = spark.range(900).select(F.format_string("S%03d", F.floor(F.col("id") / 3)).alias("symbol"), day.alias("session"))
    b.write_by_symbol(bars, str(tmp_path / "store"))
    found = b.stored_extents(spark, str(tmp_path / "store"))
    # 300 files would be ten tasks if each counted as four megabytes.
    assert found.rdd.getNumPartitions() <= 4 and found.count() == 300
    assert set(map(tuple, found.drop("symbol").distinct().collect())) == {(date(2020, 1, 1), date(2020, 1, 3), 3)}
