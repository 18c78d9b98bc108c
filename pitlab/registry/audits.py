"""Diagnostics of a run and audits of the universe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlab.plans import audit as a
from pitlab.plans import diagnostics as d
from pitlab.plans.quality import price_windows
from pitlab.plans.reports import coverage_table, diagnostics_table
from pitlab.plans.universe import membership_extents, missing_members, universe_as_of
from pitlab.plans import momentum
from pitlab.registry import Query
from pitlab.registry.signals import PARAMS, signal_ctes
from pitlab.registry.universes import claims
from pitlab.session import materialize
from pitlab.standins.frames import Standins, misfiled
from pitlab.standins.sql import with_tables as T


def _priced(s: Standins) -> DataFrame:
    """Prices, those of the names that end in 9 filed under another name."""
    return misfiled(s.bars, F.col("symbol").endswith("9"))


def _unusable(s: Standins) -> DataFrame:
    return s.securities.filter("status = 'DELISTED'").select(
        F.concat(F.lit("S"), F.substring("seed_key", 5, 6)).alias("symbol"), F.lit("identity_mismatch").alias("reason")
    )


def _parts(s: Standins) -> tuple[DataFrame, DataFrame, DataFrame]:
    universe = materialize(universe_as_of(s.memberships, s.rebalances), "universe")
    judged = materialize(momentum.evaluate(_priced(s), s.calendar, s.rebalances, PARAMS, universe, _unusable(s)), "judged")
    table = d.rebalance_diagnostics(s.rebalances, universe, _priced(s), judged, PARAMS, _unusable(s))
    return universe, judged, table


_BAD = "SELECT DISTINCT 'S' || substr(seed_key, 5, 6) AS symbol FROM securities WHERE status = 'DELISTED'"
_RUN = {
    "bad": _BAD,
    **signal_ctes(PARAMS, "SELECT as_of, symbol FROM universe WHERE symbol NOT LIKE '%9' AND symbol NOT IN (SELECT symbol FROM bad) AND symbol IN (SELECT symbol FROM bars)"),
    "states": """SELECT as_of, symbol, CASE WHEN symbol LIKE '%9' THEN 'missing' WHEN symbol IN (SELECT symbol FROM bad) THEN 'unusable' ELSE 'priced' END AS state FROM universe""",
    "diag": """
  SELECT r.as_of, COALESCE(u.n, 0) AS universe_members, COALESCE(u.miss, 0) AS missing_market_data, COALESCE(u.bad, 0) AS unusable_market_data,
         COALESCE(j.ih, 0) AS insufficient_history, COALESCE(j.fp, 0) AS failed_price_filter, COALESCE(j.fl, 0) AS failed_liquidity_filter,
         COALESCE(j.el, 0) AS momentum_eligible, LEAST(COALESCE(j.el, 0), 10) AS selected
  FROM rebalances r
  LEFT JOIN (SELECT as_of, COUNT(*) AS n, COUNT(*) FILTER (WHERE state = 'missing') AS miss, COUNT(*) FILTER (WHERE state = 'unusable') AS bad FROM states GROUP BY as_of) u ON u.as_of = r.as_of
  LEFT JOIN (SELECT as_of, COUNT(*) FILTER (WHERE disposition = 'insufficient_history') AS ih, COUNT(*) FILTER (WHERE disposition = 'failed_price_filter') AS fp,
                    COUNT(*) FILTER (WHERE disposition = 'failed_liquidity_filter') AS fl, COUNT(*) FILTER (WHERE disposition = 'eligible') AS el FROM judged GROUP BY as_of) j ON j.as_of = r.as_of""",
    "short": "SELECT DISTINCT symbol FROM judged WHERE disposition = 'insufficient_history'",
}
_SNAPSHOT = """
  SELECT (SELECT MAX(universe_members) FROM diag) AS universe_member_peak, COUNT(*) AS universe_members,
         COUNT(*) FILTER (WHERE state = 'priced' AND symbol NOT IN (SELECT symbol FROM short)) AS market_data_available, COUNT(*) FILTER (WHERE state = 'missing') AS missing_market_data,
         COUNT(*) FILTER (WHERE state = 'unusable') AS unusable_market_data, COUNT(*) FILTER (WHERE symbol IN (SELECT symbol FROM short)) AS insufficient_history,
         (SELECT arg_max(momentum_eligible, as_of) FROM diag) AS momentum_eligible, (SELECT arg_max(selected, as_of) FROM diag) AS selected
  FROM (SELECT DISTINCT symbol, state FROM states) q"""


def _snapshot(s: Standins) -> DataFrame:
    universe, judged, table = _parts(s)
    return d.coverage_snapshot(table, universe, _priced(s), judged, _unusable(s))


def _missing(s: Standins) -> DataFrame:
    return missing_members(universe_as_of(s.memberships, s.rebalances), _priced(s))


def _warnings(s: Standins) -> DataFrame:
    _, _, table = _parts(s)
    return d.warnings(table, _missing(s), _unusable(s), PARAMS.lookback, explicit_signal_start=True)


def _verdict(s: Standins) -> DataFrame:
    fills = s.orders.filter("market_price is not null").select(F.col("position_key").alias("symbol"))
    unvalued = s.holdings.filter("not valued").select("symbol")
    held = s.holdings.filter("quantity > 40").select("symbol")
    return d.quality_verdict(unvalued, _unusable(s), fills, held, _missing(s))


def _members(s: Standins) -> DataFrame:
    """Index intervals of good and bad standing: the right ones, disputed claims (those of names
    ending in 4 under the same name, the others under another), and a fixture row for each name ending in 5."""
    good = s.memberships.withColumn("source", F.lit("index-history"))
    bad = misfiled(claims(s), ~F.col("symbol").endswith("4")).drop("p_type").withColumn("source", F.lit("claims"))
    fixture = s.memberships.filter(F.col("symbol").endswith("5")).groupBy("symbol").agg(
        F.date_sub(F.min("start_date"), 900).alias("start_date"), F.date_sub(F.min("start_date"), 800).alias("end_date")
    ).withColumn("source", F.lit("test-fixture"))
    return good.unionByName(bad).unionByName(fixture)


def _windows(s: Standins) -> DataFrame:
    """Price windows that start late for names ending in 6 and end early for those ending in 7."""
    late = F.col("symbol").endswith("6") & (F.col("session") < "1997-01-01")
    early = F.col("symbol").endswith("7") & (F.col("session") >= "2000-01-01")
    return price_windows(misfiled(s.bars, late | early))


_AUDIT = {
    "claims": """
  SELECT symbol, start_date, CASE WHEN n % 13 = 0 THEN start_date - 3 WHEN y = 2001 AND n % 2 = 0 THEN NULL ELSE last + 1 END AS end_date
  FROM (SELECT printf('S%06d', l_suppkey) AS symbol, p_type, year(l_shipdate) AS y, MIN(CAST(l_shipdate AS DATE)) AS start_date,
               MAX(CAST(l_shipdate AS DATE)) AS last, COUNT(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3) q,
       range(1, 4) r(c) WHERE c <= n % 3 + 1""",
    "mem": """
  SELECT symbol, start_date, end_date, 'index-history' AS source FROM memberships UNION ALL SELECT CASE WHEN symbol LIKE '%4' THEN symbol ELSE symbol || '-' END, start_date, end_date, 'claims' FROM claims
  UNION ALL SELECT symbol, MIN(start_date) - 900, MIN(start_date) - 800, 'test-fixture' FROM memberships WHERE symbol LIKE '%5' GROUP BY symbol""",
    "win": """
  SELECT symbol, MIN(session) AS f, MAX(session) AS l
  FROM (SELECT CASE WHEN symbol LIKE '%6' AND session < DATE '1997-01-01' OR symbol LIKE '%7' AND session >= DATE '2000-01-01' THEN symbol || '-' ELSE symbol END AS symbol, session FROM bars) b
  GROUP BY symbol""",
    "uniq": "SELECT symbol, start_date, end_date, COUNT(*) AS copies FROM mem GROUP BY symbol, start_date, end_date",
    "checked": """
  SELECT a.symbol, a.start_date, a.end_date, ANY_VALUE(a.copies) AS copies, COALESCE(a.start_date >= a.end_date, FALSE) AS impossible,
         COUNT(b.symbol) FILTER (WHERE (a.start_date <> b.start_date OR a.end_date IS DISTINCT FROM b.end_date)) AS n
  FROM uniq a LEFT JOIN uniq b ON a.symbol = b.symbol AND COALESCE(a.start_date < a.end_date, TRUE) AND COALESCE(b.start_date < b.end_date, TRUE)
       AND a.start_date < COALESCE(b.end_date, DATE '9999-12-31') AND b.start_date < COALESCE(a.end_date, DATE '9999-12-31')
  GROUP BY a.symbol, a.start_date, a.end_date""",
    "ext": "SELECT symbol, MIN(start_date) AS s, CASE WHEN COUNT(*) = COUNT(end_date) THEN MAX(end_date) END AS e, BOOL_OR(source = 'test-fixture') AS fixture, MIN(source) AS source FROM mem GROUP BY symbol",
    "flags": """
  SELECT e.symbol, e.source, e.fixture, c.invalid, c.overlapping,
         COALESCE(e.s < w.f AND date_diff('day', (SELECT MIN(f) FROM win), w.f) > 365, FALSE) AS late_price_start,
         COALESCE(date_diff('day', w.l, (SELECT MAX(l) FROM win)) > 365 AND (e.e IS NULL OR w.l < e.e), FALSE) AS after_prices, FALSE AS leaked, w.f, w.l
  FROM ext e JOIN (SELECT symbol, BOOL_OR(impossible) AS invalid, BOOL_OR(n > 0) AS overlapping FROM checked GROUP BY symbol) c ON c.symbol = e.symbol
  LEFT JOIN win w ON w.symbol = e.symbol""",
    "flagged": "SELECT *, fixture OR invalid OR overlapping OR late_price_start OR after_prices AS suspicious FROM flags",
    "seen": """
  SELECT m.symbol, MIN(r.as_of) AS first_appearance, MAX(r.as_of) AS last_appearance, COUNT(DISTINCT r.as_of) AS appearances FROM rebalances r
  JOIN mem m ON m.start_date <= r.as_of AND (m.end_date IS NULL OR r.as_of < m.end_date) GROUP BY m.symbol""",
    "sizes": "SELECT r.as_of, COUNT(DISTINCT m.symbol) AS n FROM rebalances r LEFT JOIN mem m ON m.start_date <= r.as_of AND (m.end_date IS NULL OR r.as_of < m.end_date) GROUP BY r.as_of",
}


def _audited(s: Standins) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memberships, price windows, flags), the first two written once: every flag reads them."""
    members = materialize(_members(s).select("symbol", "start_date", "end_date", "source"), "members")
    windows = materialize(_windows(s), "windows")
    return members, windows, a.symbol_flags(members, windows, s.rebalances)


def _flags(s: Standins) -> DataFrame:
    return _audited(s)[2]


def _classes(s: Standins) -> DataFrame:
    members, windows, flags = _audited(s)
    return a.classify_symbols(flags, members, windows, s.rebalances).drop("note", "label")


def _audit(s: Standins) -> DataFrame:
    members, windows, flags = _audited(s)
    return a.audit_universe(members, windows, s.rebalances, materialize(flags, "flags"))


QUERIES: dict[str, Query] = {
    "rebalance_diagnostics": Query(
        lambda s: _parts(s)[2], T("bars universe rebalances securities", "SELECT * FROM diag", _RUN), "A06 A05 J04 J05 P18 D15"
    ),
    "coverage_snapshot": Query(
        lambda s: _snapshot(s), T("bars universe rebalances securities", _SNAPSHOT, _RUN), "A07"
    ),
    "coverage_snapshot_table": Query(
        lambda s: coverage_table(_snapshot(s)),
        T("bars universe rebalances securities", f"SELECT metric, value FROM (UNPIVOT ({_SNAPSHOT}) ON COLUMNS(*) INTO NAME metric VALUE value) u", _RUN),
        "P23",
    ),
    "missing_data_summary": Query(
        lambda s: d.missing_summary(_missing(s)),
        T(
            "universe",
            """SELECT (SELECT COUNT(DISTINCT symbol) FROM m) AS distinct_missing, (SELECT MAX(n) FROM (SELECT COUNT(*) AS n FROM m GROUP BY as_of) x) AS peak,
                      (SELECT COUNT(DISTINCT as_of) FROM m) AS dates, (SELECT string_agg(symbol, ', ' ORDER BY symbol) FROM (SELECT DISTINCT symbol FROM m ORDER BY symbol LIMIT 20) y) AS sample""",
            {"m": "SELECT as_of, symbol FROM universe WHERE symbol LIKE '%9'"},
        ),
        "A08 T04",
    ),
    "run_warnings": Query(
        _warnings,
        T(
            "bars universe rebalances securities",
            """SELECT 'missing_market_data' AS code, COUNT(*) AS n, string_agg(symbol, ', ' ORDER BY symbol) FILTER (WHERE k <= 20) AS sample
               FROM (SELECT symbol, ROW_NUMBER() OVER (ORDER BY symbol) AS k FROM (SELECT DISTINCT symbol FROM universe WHERE symbol LIKE '%9') x) y
               UNION ALL SELECT 'unusable_price_series', COUNT(*), string_agg(symbol, ', ' ORDER BY symbol) FILTER (WHERE k <= 20)
               FROM (SELECT symbol, ROW_NUMBER() OVER (ORDER BY symbol) AS k FROM bad) z
               UNION ALL SELECT 'insufficient_warmup', insufficient_history, 'needs 253 bars by ' || strftime(as_of, '%Y-%m-%d')
               FROM diag WHERE as_of = (SELECT MIN(as_of) FROM diag) AND selected = 0 AND momentum_eligible = 0 AND insufficient_history > 0""",
            _RUN,
        ),
        "A08",
    ),
    "quality_verdict": Query(
        _verdict,
        T(
            "holdings trades universe securities",
            """SELECT *, CASE WHEN stuck_positions + unusable_fills + stale_marks + missing_market_data + unusable_symbols > 0 THEN 'DATA_QUALITY_INCOMPLETE' ELSE 'COMPLETE' END AS status
               FROM (SELECT (SELECT COUNT(DISTINCT symbol) FROM holdings WHERE NOT valued) AS stuck_positions,
                            (SELECT COUNT(DISTINCT position_key) FROM trades WHERE market_price IS NOT NULL AND position_key IN (SELECT symbol FROM bad)) AS unusable_fills,
                            (SELECT COUNT(DISTINCT symbol) FROM holdings WHERE NOT valued AND symbol IN (SELECT symbol FROM holdings WHERE quantity > 40)) AS stale_marks,
                            (SELECT COUNT(DISTINCT symbol) FROM universe WHERE symbol LIKE '%9') AS missing_market_data, (SELECT COUNT(*) FROM bad) AS unusable_symbols) q""",
            {"bad": _BAD},
        ),
        "A22",
    ),
    "diagnostics_rows": Query(
        lambda s: diagnostics_table(_parts(s)[2]),
        T(
            "bars universe rebalances securities",
            """SELECT as_of AS date, universe_members AS members, missing_market_data AS missing, unusable_market_data AS unusable, insufficient_history, failed_price_filter AS price,
                      failed_liquidity_filter AS liquidity, momentum_eligible AS eligible, selected FROM diag""",
            _RUN,
        ),
        "P23",
    ),
    "suffixed_symbols": Query(
        lambda s: a.suffixed_symbols(s.vendor.select(F.col("vendor_symbol").alias("symbol"))),
        T("vendor", "SELECT DISTINCT vendor_symbol AS symbol FROM vendor WHERE regexp_matches(vendor_symbol, '-[0-9]{6}$')"),
        "Q04",
    ),
    "symbol_flags": Query(
        _flags,
        T(
            "memberships bars rebalances",
            "SELECT symbol, invalid, overlapping, fixture, late_price_start, after_prices, leaked, suspicious FROM flagged",
            _AUDIT,
        ),
        "Q01 Q02 Q03 Q04 U04",
    ),
    "symbol_classes": Query(
        _classes,
        T(
            "memberships bars rebalances",
            """SELECT g.symbol, v.first_appearance, v.last_appearance, COALESCE(v.appearances, 0) AS appearances, g.source, g.f AS price_first, g.l AS price_last,
                      CASE WHEN g.fixture THEN 'd' WHEN g.invalid OR g.overlapping THEN 'e' WHEN g.late_price_start OR g.after_prices THEN 'f' ELSE 'a' END AS class
               FROM flagged g LEFT JOIN seen v ON v.symbol = g.symbol""",
            _AUDIT,
        ),
        "Q05 W11",
    ),
    "universe_audit": Query(
        _audit,
        T(
            "memberships bars rebalances",
            """SELECT (SELECT CAST(SUM(copies) AS BIGINT) FROM checked) AS intervals, (SELECT CAST(SUM(copies - 1) AS BIGINT) FROM checked) AS duplicates,
                      (SELECT CAST(COALESCE(SUM(copies) FILTER (WHERE impossible), 0) AS BIGINT) FROM checked) AS invalid_intervals, (SELECT CAST(SUM(n) AS BIGINT) FROM checked) AS overlap_issues,
                      (SELECT MIN(n) FROM sizes) AS smallest, (SELECT MAX(n) FROM sizes) AS largest, (SELECT COUNT(*) FROM sizes) AS dates, COUNT(*) AS symbols,
                      COUNT(*) FILTER (WHERE fixture) AS fixture_symbols, COUNT(*) FILTER (WHERE late_price_start) AS late_price_start_symbols,
                      COUNT(*) FILTER (WHERE after_prices) AS after_prices_symbols, COUNT(*) FILTER (WHERE leaked) AS leaked_symbols, COUNT(*) FILTER (WHERE suspicious) AS suspicious_symbols
               FROM flagged""",
            _AUDIT,
        ),
        "A21",
    ),
    "late_price_starts": Query(
        lambda s: a.late_price_start(membership_extents(s.memberships), _windows(s)),
        T(
            "memberships bars",
            """SELECT m.symbol FROM (SELECT symbol, MIN(start_date) AS s FROM memberships GROUP BY symbol) m JOIN win w ON w.symbol = m.symbol
               WHERE m.s < w.f AND date_diff('day', (SELECT MIN(f) FROM win), w.f) > 365""",
            {"win": _AUDIT["win"]},
        ),
        "Q02",
    ),
}
