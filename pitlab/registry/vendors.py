"""Vendor mapping and the gates over it."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlab.plans import vendor_checks as v
from pitlab.plans.universe import cross_check, universe_as_of
from pitlab.registry import Query
from pitlab.registry.identities import resolve_cte
from pitlab.session import materialize
from pitlab.standins.frames import Standins, misfiled
from pitlab.standins.sql import with_tables as T

START, END = date(1995, 6, 1), date(2001, 9, 30)
WINDOW = v.EvalWindow(date(1997, 1, 1), date(2000, 12, 31))


def _overlay(s: Standins) -> DataFrame:
    """Occupancies outside the index: names of recycled tickers before their change."""
    return s.tickers.filter("scheme = 'listing' and valid_to is not null").select(
        "ticker", F.col("valid_from").alias("start_date"), F.col("valid_to").alias("end_date"), "seed_key"
    )


def _occupancies(s: Standins) -> DataFrame:
    return v.build_occupancies(s.memberships, s.securities, s.tickers, START, END, _overlay(s))


def _frozen(s: Standins) -> DataFrame:
    """Known suffixes of the delisted names, for the occupancy that ends with the listing."""
    return s.tickers.filter("scheme = 'listing' and valid_to = date'2001-10-01'").select(
        "ticker", F.concat("ticker", F.lit("-200110")).alias("suffix_symbol"), F.col("valid_to")
    )


def _successors(s: Standins) -> DataFrame:
    old = s.tickers.filter("scheme = 'listing' and valid_to is not null").select("seed_key", F.col("ticker").alias("predecessor"))
    new = s.tickers.filter("scheme = 'listing' and valid_to is null").select("seed_key", F.col("ticker").alias("successor"))
    return old.join(new, "seed_key").select("predecessor", "successor").distinct()


def mappings(s: Standins) -> DataFrame:
    return v.map_occupancies(_occupancies(s), s.vendor, s.tickers, WINDOW, _frozen(s), _successors(s))


_OCC = {
    "raw_occ": """
  SELECT symbol AS ticker, start_date, end_date, CASE WHEN end_date IS NULL THEN start_date ELSE start_date + CAST(date_diff('day', start_date, end_date) // 2 AS INTEGER) END AS d, CAST(NULL AS VARCHAR) AS given, FALSE AS overlay
  FROM memberships WHERE start_date <= DATE '2001-09-30' AND (end_date IS NULL OR DATE '1995-06-01' < end_date)
  UNION ALL SELECT ticker, valid_from, valid_to, valid_from, seed_key, TRUE FROM tickers WHERE scheme = 'listing' AND valid_to IS NOT NULL""",
    "occ0": "SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker, start_date, end_date ORDER BY overlay, given) AS k FROM raw_occ) q WHERE k = 1",
    "occ_seed": resolve_cte("occ_seed", "SELECT ticker, d FROM occ0", "listing"),
    "occ": """
  SELECT o.ticker, o.start_date, o.end_date, COALESCE(c.display_name, '') AS expected_identity,
         COALESCE(r.seed, o.given, 'pit:' || o.ticker || ':' || strftime(o.start_date, '%Y-%m-%d') || ':' || COALESCE(strftime(o.end_date, '%Y-%m-%d'), 'open')) AS seed_key, o.overlay
  FROM occ0 o JOIN occ_seed r ON r.ticker = o.ticker AND r.d = o.d LEFT JOIN securities c ON c.seed_key = r.seed""",
}
_MAP = {
    **_OCC,
    "mids": """SELECT *, start_date + CAST(GREATEST(date_diff('day', start_date, COALESCE(end_date, DATE '2000-12-31')), 0) // 2 AS INTEGER) AS mid,
               GREATEST(DATE '1997-01-01', start_date) AS e0, CASE WHEN end_date IS NULL THEN DATE '2000-12-31' ELSE LEAST(DATE '2000-12-31', end_date - 1) END AS e1 FROM occ""",
    "then_seed": resolve_cte("then_seed", "SELECT ticker, mid AS d FROM mids", "listing"),
    "now_seed": resolve_cte("now_seed", "SELECT ticker, DATE '2000-12-31' AS d FROM mids", "listing"),
    "judged": """
  SELECT m.*, CASE WHEN t.seed IS NULL THEN m.end_date IS NULL WHEN n.seed IS NULL THEN FALSE ELSE t.seed = n.seed END AS may
  FROM mids m JOIN then_seed t ON t.ticker = m.ticker AND t.d = m.mid JOIN now_seed n ON n.ticker = m.ticker""",
    "cands": """
  SELECT ticker, start_date, end_date, ticker AS sym, 0 AS pri, 'current_ticker' AS src FROM judged WHERE may
  UNION ALL SELECT j.ticker, j.start_date, j.end_date, j.ticker || '-200110', 1, 'frozen_suffix' FROM judged j JOIN tickers t ON t.scheme = 'listing' AND t.ticker = j.ticker AND t.valid_to = j.end_date AND t.valid_to = DATE '2001-10-01'
  UNION ALL SELECT j.ticker, j.start_date, j.end_date, j.ticker || '-200110', 2, 'frozen_suffix' FROM judged j WHERE j.ticker IN (SELECT ticker FROM tickers WHERE scheme = 'listing' AND valid_to = DATE '2001-10-01')
  UNION ALL SELECT j.ticker, j.start_date, j.end_date, x.vendor_symbol, 3, 'delisted_suffix' FROM judged j JOIN vendor x ON regexp_matches(x.vendor_symbol, '-[0-9]{6}$') AND regexp_replace(x.vendor_symbol, '-[0-9]{6}$', '') = j.ticker
  UNION ALL SELECT DISTINCT j.ticker, j.start_date, j.end_date, b.ticker, 4, 'successor_ticker' FROM judged j
            JOIN tickers a ON a.scheme = 'listing' AND a.valid_to IS NOT NULL AND a.ticker = j.ticker JOIN tickers b ON b.scheme = 'listing' AND b.valid_to IS NULL AND b.seed_key = a.seed_key""",
    "usable": """
  SELECT c.*, x.asset_id, x.security_name, x.first_quoted, x.last_quoted FROM cands c JOIN vendor x ON x.vendor_symbol = c.sym
  JOIN judged j ON j.ticker = c.ticker AND j.start_date = c.start_date AND j.end_date IS NOT DISTINCT FROM c.end_date
  WHERE c.pri = 0 OR (j.e0 <= j.e1 AND x.first_quoted <= j.e1 AND COALESCE(x.last_quoted, DATE '2000-12-31') >= j.e0)""",
    "best": """
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker, start_date, end_date ORDER BY pri, sym) AS k FROM usable) q WHERE k = 1""",
    "assets": "SELECT ticker, start_date, end_date, COUNT(DISTINCT asset_id) FILTER (WHERE pri > 0) AS n FROM usable GROUP BY ALL",
    "mapped": """
  SELECT j.ticker, j.start_date, j.end_date, j.seed_key, j.overlay, j.may, j.e0, j.e1, b.sym AS vendor_symbol, b.asset_id, b.first_quoted, b.last_quoted, COALESCE(b.src, '') AS identity_source,
         CASE WHEN b.sym IS NULL THEN 'UNRESOLVED' WHEN b.pri > 0 AND a.n > 1 THEN 'CONFLICT' ELSE 'MAPPED' END AS mapping_status
  FROM judged j LEFT JOIN best b ON b.ticker = j.ticker AND b.start_date = j.start_date AND b.end_date IS NOT DISTINCT FROM j.end_date
  LEFT JOIN assets a ON a.ticker = j.ticker AND a.start_date = j.start_date AND a.end_date IS NOT DISTINCT FROM j.end_date""",
}


def _staged(s: Standins) -> DataFrame:
    """Vendor series per asset: the live symbol's bars belong to its asset, older ones to the delisted."""
    names = s.vendor.select(F.col("vendor_symbol"), "asset_id", "first_quoted", "last_quoted").withColumn(
        "symbol", F.regexp_replace(F.regexp_replace("vendor_symbol", "-[0-9]{6}$", ""), "X$", "")
    )
    inside = (F.col("session") >= F.col("first_quoted")) & (F.col("last_quoted").isNull() | (F.col("session") <= F.col("last_quoted")))
    return s.bars.join(names, "symbol").filter(inside).select("asset_id", "session").distinct()


_STAGED = """
  SELECT DISTINCT x.asset_id, b.session FROM vendor x JOIN bars b ON b.symbol = substr(x.vendor_symbol, 1, 7) AND b.session >= x.first_quoted AND (x.last_quoted IS NULL OR b.session <= x.last_quoted)"""


def _cover(s: Standins) -> DataFrame:
    series = _staged(s).groupBy("asset_id").agg(F.min("session").alias("first_date"), F.max("session").alias("last_date"))
    out = v.series_cover(mappings(s).filter("mapping_status = 'MAPPED'"), series, WINDOW)
    return out.select("ticker", "start_date", "end_date", "asset_id", "covers", "has_series")


def _asked(s: Standins) -> DataFrame:
    return _in_window(universe_as_of(s.memberships, s.rebalances))


def _in_window(universe: DataFrame) -> DataFrame:
    return universe.filter(
        (F.col("as_of") >= F.lit(WINDOW.start)) & (F.col("as_of") <= F.lit(WINDOW.end))
    ).select(F.col("symbol").alias("ticker"), "as_of")


def _samples(s: Standins) -> DataFrame:
    """One sample per listing row; every digit has its own expectation."""
    digit = F.substring("ticker", 7, 1)
    return s.tickers.filter("scheme = 'listing'").select(
        "ticker",
        "valid_from",
        "valid_to",
        F.when(digit == "6", F.concat(F.lit("OTHER/"), "ticker", F.lit(", current NAME"))).when(digit == "7", "SUPPLIER#000000007").otherwise("").alias("must_not_alias"),
        F.when(F.col("valid_to").isNotNull(), F.concat("ticker", F.when(digit == "2", "-200110").otherwise("-190001"))).alias("frozen_suffix"),
        "seed_key",
    )


def _verdicts(s: Standins) -> DataFrame:
    return v.sample_verdicts(_samples(s), s.vendor, WINDOW)


_SAMPLES = {
    "samples": """
  SELECT ticker, seed_key, valid_from, valid_to, substr(ticker, 7, 1) AS digit,
         CASE WHEN valid_to IS NOT NULL THEN ticker || CASE WHEN substr(ticker, 7, 1) = '2' THEN '-200110' ELSE '-190001' END END AS frozen FROM tickers WHERE scheme = 'listing'""",
    "found": """
  SELECT s.*, CASE WHEN s.frozen IS NULL THEN n.vendor_symbol ELSE COALESCE(f.vendor_symbol, d.vendor_symbol) END AS vendor_symbol,
         CASE WHEN s.frozen IS NULL THEN n.asset_id ELSE COALESCE(f.asset_id, d.asset_id) END AS asset_id, CASE WHEN s.frozen IS NULL THEN n.first_quoted ELSE COALESCE(f.first_quoted, d.first_quoted) END AS fq,
         COALESCE(CASE WHEN s.frozen IS NULL THEN n.last_quoted WHEN f.vendor_symbol IS NOT NULL THEN f.last_quoted ELSE d.last_quoted END, DATE '2000-12-31') AS lq,
         CASE WHEN s.frozen IS NULL THEN n.security_name ELSE COALESCE(f.security_name, d.security_name) END AS security_name,
         CASE WHEN s.frozen IS NULL THEN CASE WHEN n.vendor_symbol IS NULL THEN '' ELSE 'current_ticker' END WHEN f.vendor_symbol IS NOT NULL THEN 'frozen_suffix' WHEN d.vendor_symbol IS NOT NULL THEN 'discovered_suffix' ELSE '' END AS identity_source,
         GREATEST(DATE '1997-01-01', s.valid_from) AS e0, LEAST(DATE '2000-12-31', COALESCE(s.valid_to, DATE '2000-12-31')) AS e1
  FROM samples s LEFT JOIN vendor n ON n.vendor_symbol = s.ticker LEFT JOIN vendor f ON f.vendor_symbol = s.frozen
  LEFT JOIN (SELECT substr(vendor_symbol, 1, 7) AS t, MIN(vendor_symbol) AS m FROM vendor WHERE vendor_symbol LIKE '%-%' GROUP BY 1) k ON k.t = s.ticker LEFT JOIN vendor d ON d.vendor_symbol = k.m""",
    "scored": """
  SELECT *, CASE WHEN vendor_symbol IS NULL THEN 'NOT_TESTABLE' WHEN digit = '6' THEN 'FAIL' WHEN digit = '7' AND security_name = 'SUPPLIER#000000007' THEN 'FAIL' ELSE 'PASS' END AS identity_status,
         CASE WHEN vendor_symbol IS NULL THEN 'NOT_TESTABLE' WHEN e0 > e1 THEN CASE WHEN fq <= DATE '1997-01-01' AND lq >= DATE '2000-12-31' THEN 'PASS' ELSE 'NOT_TESTABLE' END
              WHEN fq <= e0 AND lq >= e1 THEN 'PASS' ELSE 'FAIL' END AS coverage_status FROM found""",
}


def _assets(verdicts: DataFrame) -> DataFrame:
    """Asset ids that any lookup of a listing ticker gave."""
    return verdicts.groupBy("ticker").agg(
        F.array_compact(F.array_distinct(F.array(F.max("asset_id"), F.max("current_asset_id"), F.max("delisted_asset_id")))).alias("asset_ids")
    )


def _renames(s: Standins, verdicts: DataFrame | None = None) -> DataFrame:
    return v.compare_renames(_successors(s).filter("predecessor <> successor"), _assets(_verdicts(s) if verdicts is None else verdicts))


def _recycled(s: Standins, verdicts: DataFrame | None = None) -> DataFrame:
    """Old and new security of one ticker."""
    rows = (_verdicts(s) if verdicts is None else verdicts).select(F.concat_ws("@", "ticker", "seed_key").alias("row_id"), "ticker", "seed_key", "asset_id", "valid_to")
    old = rows.filter("valid_to is not null").select("ticker", F.col("row_id").alias("first"), F.col("seed_key").alias("_a"))
    new = rows.filter("valid_to is null").select("ticker", F.col("row_id").alias("second"), F.col("seed_key").alias("_b"))
    pairs = old.join(new, "ticker").filter("_a <> _b").select("first", "second")
    return v.compare_recycled(pairs, rows)


_RENAMES = {
    **_SAMPLES,
    "ids": """
  SELECT ticker, list_distinct(list_filter([MAX(asset_id), MAX(cur), MAX(del)], lambda x: x IS NOT NULL)) AS ids
  FROM (SELECT f.*, n.asset_id AS cur, z.asset_id AS del FROM found f LEFT JOIN vendor n ON n.vendor_symbol = f.ticker LEFT JOIN vendor z ON z.vendor_symbol = f.frozen) q GROUP BY ticker""",
    "renames": """
  SELECT DISTINCT a.ticker AS predecessor, b.ticker AS successor, CASE WHEN len(y.ids) = 0 THEN 'NOT_TESTABLE' WHEN len(x.ids) = 0 THEN 'PARTIAL' WHEN list_has_any(x.ids, y.ids) THEN 'PASS' ELSE 'FAIL' END AS status
  FROM tickers a JOIN tickers b ON a.scheme = 'listing' AND b.scheme = 'listing' AND a.valid_to IS NOT NULL AND b.valid_to IS NULL AND a.seed_key = b.seed_key AND a.ticker <> b.ticker
  JOIN ids x ON x.ticker = a.ticker JOIN ids y ON y.ticker = b.ticker""",
    "recycled": """
  SELECT a.ticker || '@' || a.seed_key AS first, b.ticker || '@' || b.seed_key AS second,
         CASE WHEN a.asset_id IS NULL AND b.asset_id IS NULL THEN 'NOT_TESTABLE' WHEN a.asset_id IS NULL OR b.asset_id IS NULL THEN 'PARTIAL' WHEN a.asset_id = b.asset_id THEN 'FAIL' ELSE 'PASS' END AS status
  FROM found a JOIN found b ON a.ticker = b.ticker AND a.valid_to IS NOT NULL AND b.valid_to IS NULL AND a.seed_key <> b.seed_key""",
}


def _gates(s: Standins) -> DataFrame:
    """All gates, each from one evaluation of the verdicts, the mappings and the series."""
    verdicts, mapped = materialize(_verdicts(s), "verdicts"), materialize(mappings(s), "mappings")
    universe = materialize(universe_as_of(s.memberships, s.rebalances), "universe")
    other = universe_as_of(s.memberships.withColumn("end_date", F.date_add("end_date", 40)), s.rebalances)
    parts = [
        v.sample_gates(verdicts),
        v.pair_gate("F3", _renames(s, verdicts)),
        v.pair_gate("F4", _recycled(s, verdicts)),
        v.occupancy_gates(mapped, materialize(_staged(s), "staged"), _in_window(universe), START, END, WINDOW),
        v.series_gates(s.bars, s.bars),
        v.membership_gate(cross_check(universe, other)),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _gates_that_fail(s: Standins) -> DataFrame:
    """Each gate on inputs that it must not let pass."""
    verdicts, mapped = materialize(_verdicts(s), "verdicts"), materialize(mappings(s), "mappings")
    live = (F.col("identity_source") == "current_ticker") & F.col("ticker").endswith("8")
    none = universe_as_of(s.memberships.filter("false"), s.rebalances)
    staged, asked = materialize(_staged(s), "staged"), materialize(_asked(s), "asked")
    flat = s.bars.withColumn("adjusted_close", F.col("close"))
    bad = flat.withColumn("low", F.when(F.col("symbol").endswith("4"), F.lit(0).cast("decimal(18,6)")).otherwise(F.col("low")))
    cases = {
        "foreign": v.occupancy_gates(mapped.withColumn("contaminated", live), staged, asked, START, END, WINDOW).filter("gate = 'U1'"),
        "untried": v.occupancy_gates(mapped, staged, asked, START, END, WINDOW, expected_tickers=1_000_000_000).filter("gate = 'U1'"),
        "unadjusted": v.series_gates(flat, flat),
        "bad bars": v.series_gates(bad, flat),
        "no raw": v.series_gates(flat, flat.filter("false")),
        "no series": v.series_gates(flat.filter("false"), flat),
        "no second source": v.membership_gate(cross_check(none, none)),
        "no samples": v.sample_gates(verdicts.filter("false")),
        "unproven": v.sample_gates(verdicts.filter("identity_status <> 'FAIL' AND coverage_status = 'NOT_TESTABLE'")),
        "no pairs": v.pair_gate("F4", _recycled(s, verdicts).filter("false")),
    }
    return reduce(lambda a, b: a.unionByName(b), (gates.select(F.lit(defect).alias("defect"), "*") for defect, gates in cases.items()))


_GATES = {
    **_MAP,
    **{k: t for k, t in _RENAMES.items()},
    "staged": _STAGED,
    "gapped": """SELECT DISTINCT asset_id FROM (SELECT asset_id, date_diff('day', LAG(session) OVER (PARTITION BY asset_id ORDER BY session), session) AS g FROM staged) q WHERE g > 14""",
    "cover": """
  SELECT m.*, w.f IS NOT NULL AS has_series, COALESCE(w.f <= m.e0 AND w.l >= LEAST(m.e1, COALESCE(m.last_quoted, m.e1)), FALSE) AS covers, m.asset_id IN (SELECT asset_id FROM gapped) AS gap
  FROM mapped m LEFT JOIN (SELECT asset_id, MIN(session) AS f, MAX(session) AS l FROM staged GROUP BY asset_id) w ON w.asset_id = m.asset_id WHERE m.mapping_status = 'MAPPED' AND m.e0 <= m.e1""",
    "asked": """
  SELECT u.symbol, u.as_of, COUNT(m.ticker) AS n FROM universe u LEFT JOIN mapped m ON m.ticker = u.symbol AND m.start_date <= u.as_of AND (m.end_date IS NULL OR u.as_of < m.end_date)
  WHERE u.as_of BETWEEN DATE '1997-01-01' AND DATE '2000-12-31' GROUP BY ALL""",
    "other": """SELECT DISTINCT r.as_of, m.symbol FROM rebalances r JOIN memberships m ON m.start_date <= r.as_of AND (m.end_date IS NULL OR r.as_of < m.end_date + 40)""",
}

QUERIES: dict[str, Query] = {
    "occupancies": Query(
        _occupancies,
        T("memberships tickers securities", "SELECT ticker, start_date, end_date, expected_identity, seed_key, overlay FROM occ", _OCC),
        "J23 D14",
    ),
    "occupancy_map": Query(
        lambda s: mappings(s).select(
            "ticker", "start_date", "end_date", "seed_key", "vendor_symbol", "asset_id", "identity_source", "mapping_status", "may_use_current", "contaminated"
        ),
        T(
            "memberships tickers securities vendor",
            """SELECT ticker, start_date, end_date, seed_key, vendor_symbol, asset_id, identity_source, mapping_status, may AS may_use_current,
                      identity_source = 'current_ticker' AND NOT may AS contaminated FROM mapped""",
            _MAP,
        ),
        "J21 J22",
    ),
    "occupancy_as_of": Query(
        lambda s: v.occupancy_at(mappings(s), _asked(s)).select("ticker", "as_of", "matches", "asset_id"),
        T(
            "memberships tickers securities vendor universe",
            """SELECT u.symbol AS ticker, u.as_of, COUNT(m.ticker) AS matches, CASE WHEN COUNT(m.ticker) = 1 THEN MIN(m.asset_id) END AS asset_id
               FROM universe u LEFT JOIN mapped m ON m.ticker = u.symbol AND m.start_date <= u.as_of AND (m.end_date IS NULL OR u.as_of < m.end_date)
               WHERE u.as_of BETWEEN DATE '1997-01-01' AND DATE '2000-12-31' GROUP BY u.symbol, u.as_of""",
            _MAP,
        ),
        "J22",
    ),
    "window_tickers": Query(
        lambda s: v.window_ticker_count(_occupancies(s), START, END),
        T("memberships", "SELECT COUNT(DISTINCT symbol) AS window_tickers FROM memberships WHERE start_date <= DATE '2001-09-30' AND (end_date IS NULL OR DATE '1995-06-01' < end_date)"),
        "A24",
    ),
    "occupancy_bars": Query(
        lambda s: v.clip_to_occupancy(s.bars, _occupancies(s).filter("not overlay"), WINDOW).groupBy("symbol", "start_date").agg(
            F.count(F.lit(1)).alias("bars"), F.min("session").alias("first_session"), F.max("session").alias("last_session")
        ),
        T(
            "memberships bars",
            """SELECT m.symbol, m.start_date, COUNT(*) AS bars, MIN(b.session) AS first_session, MAX(b.session) AS last_session FROM memberships m
               JOIN bars b ON b.symbol = m.symbol AND b.session BETWEEN GREATEST(DATE '1997-01-01', m.start_date) AND LEAST(DATE '2000-12-31', COALESCE(m.end_date - 1, DATE '2000-12-31'))
               WHERE m.start_date <= DATE '2001-09-30' AND (m.end_date IS NULL OR DATE '1995-06-01' < m.end_date) GROUP BY m.symbol, m.start_date""",
        ),
        "P19",
    ),
    "series_cover": Query(
        _cover,
        T(
            "memberships tickers securities vendor bars universe",
            "SELECT ticker, start_date, end_date, asset_id, covers, has_series FROM cover",
            {**_MAP, "staged": _STAGED, "gapped": _GATES["gapped"], "cover": _GATES["cover"]},
        ),
        "Q07",
    ),
    "delisted_suffixes": Query(
        lambda s: v.delisted_suffixes(s.vendor),
        T("vendor", "SELECT DISTINCT substr(vendor_symbol, 1, 7) AS ticker, vendor_symbol AS suffix_symbol FROM vendor WHERE vendor_symbol LIKE '%-%'"),
        "J25",
    ),
    "sample_verdicts": Query(
        lambda s: _verdicts(s).select("ticker", "seed_key", "valid_from", "identity_source", "vendor_symbol", "asset_id", "identity_status", "coverage_status", "verdict"),
        T(
            "tickers vendor",
            """SELECT ticker, seed_key, valid_from, identity_source, vendor_symbol, asset_id, identity_status, coverage_status,
                      CASE WHEN identity_status = 'FAIL' OR coverage_status = 'FAIL' THEN 'FAIL' WHEN identity_status = 'PASS' AND coverage_status = 'PASS' THEN 'PASS' ELSE 'NOT_TESTABLE' END AS verdict
               FROM scored""",
            _SAMPLES,
        ),
        "Q06 J28",
    ),
    "rename_pairs": Query(_renames, T("tickers vendor", "SELECT * FROM renames", _RENAMES), "J27"),
    "recycled_pairs": Query(_recycled, T("tickers vendor", "SELECT * FROM recycled", _RENAMES), "J27"),
    "adjustment_differs": Query(
        lambda s: v.adjustment_differs(misfiled(s.bars, F.col("symbol").endswith("3")), misfiled(s.bars, F.col("symbol").endswith("4"))),
        T(
            "bars",
            """SELECT symbol, CASE WHEN symbol NOT LIKE '%3' AND symbol NOT LIKE '%4' THEN BOOL_OR(COALESCE(adjusted_close, close) <> close) END AS differs FROM bars GROUP BY symbol
               UNION ALL SELECT DISTINCT symbol || '-', NULL FROM bars WHERE symbol LIKE '%3' OR symbol LIKE '%4'""",
        ),
        "J24",
    ),
    "quality_gates": Query(
        _gates,
        T(
            "memberships tickers securities vendor bars universe",
            """SELECT 'F1' AS gate, CASE WHEN BOOL_OR(identity_status = 'FAIL') THEN 'FAIL' ELSE 'PASS' END AS status, COUNT(*) FILTER (WHERE identity_status = 'FAIL') AS n FROM scored
               UNION ALL SELECT 'F2', CASE WHEN BOOL_OR(coverage_status = 'FAIL') THEN 'FAIL' WHEN NOT BOOL_OR(coverage_status = 'PASS') THEN 'NOT_TESTABLE' ELSE 'PASS' END, COUNT(*) FILTER (WHERE coverage_status = 'FAIL') FROM scored
               UNION ALL SELECT 'F3', CASE WHEN COUNT(*) = 0 THEN 'NOT_TESTABLE' WHEN BOOL_OR(status = 'FAIL') THEN 'FAIL' WHEN BOOL_AND(status = 'PASS') THEN 'PASS' ELSE 'PARTIAL' END, COUNT(*) FILTER (WHERE status = 'FAIL') FROM renames
               UNION ALL SELECT 'F4', CASE WHEN BOOL_AND(status = 'NOT_TESTABLE') THEN 'NOT_TESTABLE' WHEN BOOL_OR(status = 'FAIL') THEN 'FAIL' WHEN BOOL_AND(status = 'PASS') THEN 'PASS' ELSE 'PARTIAL' END, COUNT(*) FILTER (WHERE status = 'FAIL') FROM recycled
               UNION ALL SELECT 'U1', CASE WHEN COUNT(*) = 0 THEN 'NOT_TESTABLE' WHEN COUNT(*) FILTER (WHERE identity_source = 'current_ticker' AND NOT may) > 0 THEN 'FAIL' ELSE 'PASS' END, COUNT(*) FILTER (WHERE identity_source = 'current_ticker' AND NOT may) FROM mapped
               UNION ALL SELECT 'U2', CASE WHEN COUNT(*) FILTER (WHERE has_series AND (gap OR NOT covers)) > 0 THEN 'FAIL' ELSE 'PASS' END, COUNT(*) FILTER (WHERE has_series AND (gap OR NOT covers)) FROM cover
               UNION ALL SELECT 'J1', CASE WHEN COUNT(*) FILTER (WHERE n = 0) > 0 THEN 'FAIL' ELSE 'PASS' END, COUNT(*) FILTER (WHERE n = 0) FROM asked
               UNION ALL SELECT 'A1', CASE WHEN COUNT(*) FILTER (WHERE adjusted_close IS NULL) > 0 THEN 'FAIL' ELSE 'PASS' END, COUNT(*) FILTER (WHERE adjusted_close IS NULL) FROM bars
               UNION ALL SELECT 'A2', CASE WHEN COUNT(*) = 0 THEN 'NOT_TESTABLE' WHEN COUNT(*) FILTER (WHERE d) > 0 THEN 'PASS' ELSE 'PARTIAL' END, COUNT(*) FILTER (WHERE d) FROM (SELECT symbol, BOOL_OR(COALESCE(adjusted_close, close) <> close) AS d FROM bars GROUP BY symbol) z
               UNION ALL SELECT 'Q1', CASE WHEN COUNT(*) FILTER (WHERE adjusted_close IS NULL) > 0 THEN 'FAIL' ELSE 'PASS' END, COUNT(*) FILTER (WHERE adjusted_close IS NULL) FROM bars
               UNION ALL SELECT 'M1', CASE WHEN COUNT(*) = 0 THEN 'NOT_TESTABLE' ELSE 'PASS' END, COUNT(*) FILTER (WHERE a.symbol IS NULL OR b.symbol IS NULL) FROM universe a FULL OUTER JOIN other b ON a.as_of = b.as_of AND a.symbol = b.symbol""",
            _GATES,
        ),
        "A23",
    ),
    "failing_gates": Query(
        _gates_that_fail,
        T(
            "memberships tickers securities vendor bars",
            """SELECT 'foreign' AS defect, 'U1' AS gate, CASE WHEN COUNT(*) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, COUNT(*) AS n FROM mapped WHERE identity_source = 'current_ticker' AND ticker LIKE '%8'
               UNION ALL SELECT 'untried', 'U1', 'FAIL', COUNT(*) FILTER (WHERE identity_source = 'current_ticker' AND NOT may) FROM mapped
               UNION ALL SELECT 'unadjusted', g.gate, CASE g.gate WHEN 'A2' THEN 'PARTIAL' ELSE 'PASS' END, 0 FROM (VALUES ('A1'), ('A2'), ('Q1')) g(gate)
               UNION ALL SELECT 'bad bars', g.gate, CASE WHEN g.gate = 'A2' THEN 'PARTIAL' WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END, CASE g.gate WHEN 'A2' THEN 0 ELSE n END
               FROM (VALUES ('A1'), ('A2'), ('Q1')) g(gate), (SELECT COUNT(*) AS n FROM bars WHERE symbol LIKE '%4') b
               UNION ALL SELECT 'no raw', g.gate, CASE g.gate WHEN 'A1' THEN 'FAIL' WHEN 'A2' THEN 'NOT_TESTABLE' ELSE 'PASS' END, 0 FROM (VALUES ('A1'), ('A2'), ('Q1')) g(gate)
               UNION ALL SELECT 'no series', g.gate, CASE g.gate WHEN 'A1' THEN 'FAIL' WHEN 'A2' THEN 'NOT_TESTABLE' ELSE 'PASS' END, 0 FROM (VALUES ('A1'), ('A2'), ('Q1')) g(gate)
               UNION ALL SELECT 'no second source', 'M1', 'NOT_TESTABLE', 0
               UNION ALL SELECT 'no samples', g.gate, 'NOT_TESTABLE', 0 FROM (VALUES ('F1'), ('F2')) g(gate)
               UNION ALL SELECT 'unproven', 'F1', CASE WHEN COUNT(*) = 0 THEN 'NOT_TESTABLE' ELSE 'PASS' END, 0 FROM scored WHERE identity_status <> 'FAIL' AND coverage_status = 'NOT_TESTABLE'
               UNION ALL SELECT 'unproven', 'F2', 'NOT_TESTABLE', 0
               UNION ALL SELECT 'no pairs', 'F4', 'NOT_TESTABLE', 0""",
            {**_MAP, **_SAMPLES},
        ),
        "A23",
    ),
}
