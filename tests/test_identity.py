from __future__ import annotations

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from pitlab.operators import identity as i
from pitlab.plans import vendor_checks as v
from pitlab.plans.coverage import coverage_totals, pit_coverage
from pitlab.plans.quality import price_windows
from pitlab.sources.catalog import read_security_catalog, upsert_catalog
from pitlab.sources.sinks import write_coverage_artifacts

CATALOG = {
    "source": "seed",
    "source_version": "v1",
    "securities": [
        {"seed_key": "pipe", "display_name": "Pipe Co", "status": "DELISTED", "identifiers": [{"id_type": "CIK", "id_value": "1"}],
         "tickers": [{"scheme": "listing", "ticker": "PI", "valid_from": "2000-01-01", "valid_to": "2017-03-01"}]},
        {"seed_key": "game", "display_name": "Game Co",
         "tickers": [{"scheme": "listing", "ticker": "PI", "valid_from": "2017-11-01", "valid_to": None}, {"scheme": "yahoo", "ticker": "PI", "valid_from": "2017-11-01", "valid_to": None}]},
        {"seed_key": "pay", "display_name": "Pay Co",
         "tickers": [{"scheme": "listing", "ticker": "OLD", "valid_from": "2015-01-01", "valid_to": "2020-01-01"}, {"scheme": "listing", "ticker": "NEW", "valid_from": "2020-01-01", "valid_to": None},
                     {"scheme": "yahoo", "ticker": "NEW", "valid_from": "2015-01-01", "valid_to": None}]},
    ],
}


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("catalog") / "c.json"
    path.write_text(json.dumps(CATALOG, indent=1))
    return read_security_catalog(spark, str(path))


def ask(spark, *rows):
    return spark.createDataFrame([(t, date.fromisoformat(x)) for t, x in rows], "symbol string, session date")


def test_catalog_defaults(catalog):
    securities, tickers, ids = catalog
    game = securities.filter("seed_key = 'game'").first()
    assert (game["security_type"], game["currency"], game["status"]) == ("COMMON_STOCK", "USD", "ACTIVE")
    assert tickers.count() == 6 and ids.count() == 1
    assert tickers.filter("source = 'seed' and source_version = 'v1' and not continuity").count() == 6


def test_catalog_dates_must_be_iso(spark, tmp_path):
    bad = json.loads(json.dumps(CATALOG))
    bad["securities"][0]["tickers"][0]["valid_from"] = "01/02/2000"
    (tmp_path / "bad.json").write_text(json.dumps(bad))
    with pytest.raises(Exception, match="valid_from is not an ISO date"):
        read_security_catalog(spark, str(tmp_path / "bad.json"))[1].collect()


def test_catalog_upsert_skips_known_and_orphans(catalog):
    securities, tickers, ids = catalog
    stored = (securities.filter("seed_key = 'pipe'"), tickers.filter("seed_key = 'pipe'"), ids)
    new = upsert_catalog(stored, (securities.filter("seed_key <> 'pay'"), tickers, ids))
    assert [x.count() for x in new] == [1, 2, 0]


def test_recycled_and_boundary(spark, catalog):
    rows = ask(spark, ("PI", "2017-02-28"), ("PI", "2017-03-01"), ("PI", "2017-11-01"), ("NO", "2017-11-01"))
    got = {(r["symbol"], str(r["session"])): (r["status"], r["seed_key"]) for r in i.resolve_security(rows, catalog[1], "symbol", "session").collect()}
    assert got[("PI", "2017-02-28")] == ("RESOLVED", "pipe") and got[("PI", "2017-11-01")] == ("RESOLVED", "game")
    assert got[("PI", "2017-03-01")] == got[("NO", "2017-11-01")] == ("UNRESOLVED", None)


def test_two_matches_are_unresolved(spark, catalog):
    twice = catalog[1].unionByName(catalog[1].filter("ticker = 'NEW' and scheme = 'listing'").replace("pay", "other", "seed_key"))
    assert i.resolve_security(ask(spark, ("NEW", "2021-01-01")), twice, "symbol", "session").first()["status"] == "UNRESOLVED"


def test_vendor_names(spark, catalog):
    asked = spark.createDataFrame([("OLD", date(2016, 1, 1), date(2018, 1, 1)), ("PI", date(2016, 1, 1), date(2016, 2, 1)), ("ZZ", date(2016, 1, 1), date(2016, 2, 1))], "listing string, w_start date, w_end date")
    got = {r["listing"]: (r["fetch_symbols"], r["preferred_symbol"]) for r in i.vendor_symbols(asked, catalog[1]).collect()}
    assert got == {"OLD": (["OLD", "NEW"], "NEW"), "PI": (["PI"], "PI"), "ZZ": (["ZZ"], "ZZ")}


def test_vendor_series_replaces_listing_bars(spark, catalog):
    bars = spark.createDataFrame([("OLD", 1), ("NEW", 2), ("NEW", 3), ("PI", 4)], "symbol string, n long")
    asked = spark.createDataFrame([("OLD", date(2016, 1, 1), date(2018, 1, 1)), ("PI", date(2016, 1, 1), date(2018, 2, 1))], "listing string, w_start date, w_end date")
    got = sorted((r["listing"], r["n"]) for r in i.substitute_vendor_series(bars, i.vendor_symbols(asked, catalog[1])).collect())
    assert got == [("OLD", 2), ("OLD", 3), ("PI", 4)]


def test_identity_clip_and_mismatch(spark, catalog):
    bars = ask(spark, ("PI", "2017-05-01"), ("PI", "2018-01-01"), ("OLD", "2016-01-01"), ("NEW", "2014-01-01"), ("NEW", "2021-01-01"), ("FREE", "2000-01-01"))
    kept, unusable = i.apply_identity(bars, catalog[1])
    assert {(r["symbol"], r["session"].year) for r in kept.collect()} == {("PI", 2018), ("OLD", 2016), ("NEW", 2021), ("FREE", 2000)}
    assert [tuple(r) for r in unusable.collect()] == [("OLD", "identity_mismatch")]


def test_position_keys_fall_back(spark, catalog):
    mem = spark.createDataFrame([("GAP", date(2017, 1, 1), None), ("PI", date(2017, 1, 1), None)], "symbol string, start_date date, end_date date")
    rows = ask(spark, ("PI", "2018-01-01"), ("PI", "2017-05-01"), ("GAP", "2018-01-01"), ("WHO", "2018-01-01"))
    got = {(r["symbol"], r["session"].year): (r["status"], r["position_key"]) for r in i.resolve_identity(rows, catalog[1], mem, "symbol", "session").collect()}
    assert got == {
        ("PI", 2018): ("RESOLVED", "security:game"), ("PI", 2017): ("UNRESOLVED", "listing:_:PI:2017-01-01"),
        ("GAP", 2018): ("UNRESOLVED", "listing:_:GAP:2017-01-01"), ("WHO", 2018): ("UNRESOLVED", "listing:_:WHO:occupancy-unknown"),
    }
    clash = mem.unionByName(spark.createDataFrame([("GAP", date(2017, 6, 1), None)], mem.schema))
    signals = spark.createDataFrame([(date(2018, 1, 1), "GAP")], "as_of date, symbol string")
    with pytest.raises(Exception, match="duplicate index occupancy"):
        i.attach_signal_identities(signals, catalog[1], clash).collect()


def test_termination_includes_the_last_day(spark, catalog):
    rows = spark.createDataFrame(
        [("PI", date(2017, 2, 28), date(2017, 3, 5)), ("PI", date(2017, 3, 1), date(2017, 3, 5)), ("PI", date(2017, 3, 2), date(2017, 3, 5)), ("PI", date(2017, 2, 28), date(2017, 2, 28)), ("NEW", date(2021, 1, 1), date(2022, 1, 1))],
        "symbol string, last_bar date, session date",
    )
    got = {(r["symbol"], str(r["last_bar"]), str(r["session"])): r["terminated"] for r in i.known_terminations(rows, catalog[0], catalog[1]).collect()}
    assert [got[k] for k in sorted(got)] == [False, False, True, True, False]


def test_coverage_reasons(spark, catalog, make_bars, tmp_path):
    mem = spark.createDataFrame(
        [("PI", date(2016, 1, 1), date(2016, 6, 1)), ("OLD", date(2019, 6, 1), date(2020, 6, 1)), ("LOST", date(2019, 1, 1), None), ("BRK.Z", date(2019, 1, 1), None), ("HAVE", date(2020, 1, 1), date(2020, 1, 11))],
        "symbol string, start_date date, end_date date",
    )
    bars = make_bars({"NEW": [(-400, 1, 1, 1), (400, 1, 1, 1)], "HAVE": [(0, 1, 1, 1), (20, 1, 1, 1)]})
    rows = pit_coverage(mem, price_windows(bars), catalog[0], catalog[1], date(2015, 1, 1), date(2020, 12, 31))
    got = {r["historical_ticker"]: (r["reason"], r["quality_status"], r["coverage_days"]) for r in rows.collect()}
    assert got == {
        "PI": ("C_ticker_recycled", "not_applicable", 0), "OLD": ("G_data_under_other_ticker", "valid", 366),
        "LOST": ("D_unresolved_identity", "not_applicable", 0), "BRK.Z": ("E_vendor_symbol_differs", "not_applicable", 0), "HAVE": ("D_unresolved_identity", "valid", 10),
    }
    total = coverage_totals(rows)
    assert (total.first()["pit_securities"], total.first()["valid_data"], total.first()["missing"]) == (5, 2, 3)
    write_coverage_artifacts(rows, total, str(tmp_path))
    assert spark.read.csv(str(tmp_path / "missing"), header=True).count() == 4


def test_conflicting_vendor_assets(spark, catalog):
    vendor = spark.createDataFrame(
        [("PI", "live", "GAME", date(2017, 11, 1), None), ("PI-201703", "d1", "PIPE", date(2000, 1, 1), date(2017, 3, 1)), ("NEW", "n", "PAY", date(2015, 1, 1), None)],
        "vendor_symbol string, asset_id string, security_name string, first_quoted date, last_quoted date",
    )
    mem = spark.createDataFrame([("PI", date(2016, 1, 1), date(2016, 6, 1)), ("PI", date(2018, 1, 1), None), ("OLD", date(2016, 1, 1), date(2017, 1, 1))], "symbol string, start_date date, end_date date")
    w = v.EvalWindow(date(2015, 1, 1), date(2021, 12, 31))
    occ = v.build_occupancies(mem, catalog[0], catalog[1], date(2015, 1, 1), date(2021, 1, 1))
    heirs = spark.createDataFrame([("OLD", "NEW")], "predecessor string, successor string")
    run = lambda dirs: {(r["ticker"], r["start_date"].year): (r["mapping_status"], r["asset_id"], r["identity_source"]) for r in v.map_occupancies(occ, dirs, catalog[1], w, successors=heirs).collect()}
    got = run(vendor)
    assert got[("PI", 2016)] == ("MAPPED", "d1", "delisted_suffix") and got[("PI", 2018)] == ("MAPPED", "live", "current_ticker")
    assert got[("OLD", 2016)] == ("MAPPED", "n", "successor_ticker")
    rival = spark.createDataFrame([("PI-201612", "d2", "PIPE", date(2000, 1, 1), date(2016, 12, 1))], vendor.schema)
    assert run(vendor.unionByName(rival))[("PI", 2016)][0] == "CONFLICT"


def test_alias_rules(spark):
    from pitlab.functions.text import is_alias_identity
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("BUY-201702", "Buyer", "BUY/current PI"), ("PI", "Game", "BUY/current PI"), ("X", "THE BUY GROUP", "BUY, Foo"), ("FOO", "", "Foo"), ("Y", None, None)], "s string, n string, a string")
    assert [r[0] for r in rows.select(is_alias_identity(F.col("s"), F.col("n"), F.col("a"))).collect()] == [True, False, True, False, False]


def test_scheme_of_a_catalog_is_a_parameter(spark, catalog, make_bars):
    other = catalog[1].withColumn("scheme", F.when(F.col("scheme") == "yahoo", "other").otherwise(F.col("scheme")))
    bars = make_bars({"NEW": [(0, 1, 1, 1)]})
    assert i.has_vendor_mapping(bars, catalog[1], "symbol").count() == i.has_vendor_mapping(bars, other, "symbol", "other").count() == 1
    assert i.has_vendor_mapping(bars, other, "symbol").count() == 0
    same = [sorted(map(str, f.collect())) for f in (i.apply_identity(bars, catalog[1])[0], i.apply_identity(bars, other, "other")[0])]
    assert same[0] == same[1]


def test_substituted_series_keep_their_listing(spark, make_bars):
    """A series stored under its vendor's name is judged by the listing that asked for it."""
    tickers = spark.createDataFrame(
        [("listing", "OLD", "k1"), ("yahoo", "NEW", "k1"), ("listing", "ODD", "k2"), ("yahoo", "OTHER", "k3")], "scheme string, ticker string, seed_key string"
    ).withColumn("valid_from", F.lit(date(2015, 1, 1))).withColumn("valid_to", F.lit(None).cast("date"))
    bars = make_bars({"NEW": [(0, 1, 1, 1), (1, 2, 1, 1)], "OTHER": [(0, 1, 1, 1)]})
    named = bars.withColumn("listing", F.when(F.col("symbol") == "NEW", "OLD").otherwise("ODD"))
    kept, unusable = i.apply_identity(named, tickers, listing="listing")
    assert kept.count() == 3 and [r["symbol"] for r in unusable.collect()] == ["ODD"]
