"""Ticker and vendor identity over time."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlab.operators import identity as i
from pitlab.operators.intervals import overlap_counts
from pitlab.plans.coverage import coverage_totals, pit_coverage
from pitlab.plans.quality import price_windows
from pitlab.registry import Query
from pitlab.registry.signals import PARAMS, signal_ctes, signals
from pitlab.standins.frames import Standins, misfiled
from pitlab.standins.sql import with_tables as T

START, END = date(1996, 1, 1), date(2001, 6, 30)
ENCOUNTER = date(1997, 1, 1)
# The word of the stand-in catalog for vendor tickers.
SCHEME = "vendor"


def resolve_cte(name: str, pairs: str, scheme: str) -> str:
    """(ticker, d, seed): the seed where exactly one row of the scheme covers the day."""
    return f"""
  SELECT p.ticker, p.d, CASE WHEN COUNT(t.seed_key) = 1 THEN MIN(t.seed_key) END AS seed FROM (SELECT DISTINCT ticker, d FROM ({pairs}) x) p
  LEFT JOIN tickers t ON t.scheme = '{scheme}' AND t.ticker = p.ticker AND t.valid_from <= p.d AND (t.valid_to IS NULL OR p.d < t.valid_to)
  GROUP BY p.ticker, p.d"""


_BAR_PAIRS = "SELECT symbol AS ticker, session AS d FROM bars"
_SERIES = {
    "ls": resolve_cte("ls", _BAR_PAIRS, "listing"),
    "vs": resolve_cte("vs", _BAR_PAIRS, "vendor"),
    "series": """
  SELECT ls.ticker, BOOL_OR(ls.seed IS NOT NULL AND vs.seed IS DISTINCT FROM ls.seed) AS mismatch,
         ls.ticker IN (SELECT ticker FROM tickers WHERE scheme = 'vendor') AS has_vendor
  FROM ls JOIN vs ON ls.ticker = vs.ticker AND ls.d = vs.d GROUP BY ls.ticker""",
}


def _resolved(s: Standins) -> DataFrame:
    rows = s.bars.select("symbol", "session")
    rows = i.resolve_security(rows, s.tickers, "symbol", "session")
    rows = i.resolve_security(rows, s.tickers, "symbol", "session", SCHEME, "vendor_")
    return rows.select("symbol", "session", "status", "seed_key", "vendor_status", "vendor_seed_key")


def _clipped(s: Standins) -> DataFrame:
    kept, _ = i.apply_identity(s.bars, s.tickers, SCHEME)
    return kept.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"), F.min("session").alias("first_session"), F.max("session").alias("last_session")
    )


def _requests(s: Standins) -> DataFrame:
    listed = s.tickers.filter("scheme = 'listing'").select(F.col("ticker").alias("listing")).distinct()
    return listed.select("listing", F.lit(START).alias("w_start"), F.lit(END).alias("w_end"))


_VENDOR_NAMES = {
    "seeds": """SELECT DISTINCT ticker AS listing, seed_key FROM tickers WHERE scheme = 'listing' AND valid_from <= DATE '2001-06-30' AND (valid_to IS NULL OR DATE '1996-01-01' < valid_to)""",
    "names": """
  SELECT l.listing, string_agg(v.name, ',' ORDER BY v.at) AS others, arg_min(v.name, v.at) AS best
  FROM (SELECT DISTINCT ticker AS listing FROM tickers WHERE scheme = 'listing') l
  LEFT JOIN (SELECT s.listing, t.ticker AS name, MIN(t.ord) AS at FROM seeds s JOIN tickers t ON t.scheme = 'vendor' AND t.seed_key = s.seed_key
             AND t.valid_from <= DATE '2001-06-30' AND (t.valid_to IS NULL OR DATE '1996-01-01' < t.valid_to) WHERE t.ticker <> s.listing GROUP BY ALL) v ON v.listing = l.listing
  GROUP BY l.listing""",
}


def _substituted(s: Standins) -> DataFrame:
    """Series per listing. Bars of renamed securities are stored under their vendor name too."""
    renamed = s.tickers.filter("scheme = 'vendor' and ticker like '%X'").select(
        F.expr("substring(ticker, 1, length(ticker) - 1)").alias("symbol"), F.col("ticker").alias("_to")
    )
    stored = s.bars.select("symbol", "session", "volume")
    copies = stored.join(renamed, "symbol").select(F.col("_to").alias("symbol"), "session", (F.col("volume") * 2).alias("volume"))
    names = i.vendor_symbols(_requests(s), s.tickers, SCHEME)
    series = i.substitute_vendor_series(stored.unionByName(copies), names)
    return series.groupBy("listing", "is_vendor").agg(F.count(F.lit(1)).alias("bars"), F.sum("volume").alias("volume"))


def _attached(s: Standins) -> DataFrame:
    picked = signals(s).select("as_of", "symbol", "rank")
    full = i.attach_signal_identities(picked, s.tickers, s.memberships)
    return full.select("as_of", "symbol", "rank", "status", "security_id", "listing_id", "position_key")


def _identity_sample(s: Standins) -> DataFrame:
    """Identity of every member at each of its own interval starts and ends."""
    m = s.memberships
    days = m.select("symbol", F.col("start_date").alias("on_day")).union(m.select("symbol", "end_date").filter("end_date is not null"))
    full = i.resolve_identity(days.distinct(), s.tickers, m, "symbol", "on_day")
    return full.select("symbol", "on_day", "status", "security_id", "listing_id", "position_key", "occupancy_conflict")


def _terminated(s: Standins) -> DataFrame:
    """Names whose tape stops before the last session, judged against the catalog.

    Every half year the tape is cut off, so that many listings look ended.
    """
    cut = F.make_date(F.year("session"), F.when(F.month("session") <= 6, 7).otherwise(12), F.lit(1))
    ended = s.bars.groupBy("symbol", cut.alias("session_")).agg(F.max("session").alias("last_bar")).withColumnRenamed("session_", "session")
    return i.known_terminations(ended, s.securities, s.tickers).select("symbol", "last_bar", "session", "terminated")


def _coverage(s: Standins) -> DataFrame:
    kept = misfiled(s.bars, (F.year("session") >= 1999) & F.col("symbol").endswith("6") | F.col("symbol").endswith("8"))
    return pit_coverage(s.memberships, price_windows(kept), s.securities, s.tickers, START, END, ENCOUNTER, SCHEME)


_COVERAGE = {
    "kept": "SELECT * FROM bars WHERE (year(session) < 1999 OR symbol NOT LIKE '%6') AND symbol NOT LIKE '%8'",
    "win": "SELECT symbol, MIN(session) AS f, MAX(session) AS l FROM kept GROUP BY symbol",
    "folded": """
  SELECT symbol, MIN(start_date) AS pit_start, CASE WHEN COUNT(*) = COUNT(end_date) THEN MAX(end_date) END AS pit_end,
         string_agg(strftime(start_date, '%Y-%m-%d') || '→' || COALESCE(strftime(end_date, '%Y-%m-%d'), 'open'), '; ' ORDER BY start_date) AS pit_intervals,
         MIN(GREATEST(start_date, DATE '1996-01-01')) AS e0, MAX(LEAST(COALESCE(end_date, DATE '2001-07-01'), DATE '2001-07-01')) AS e1
  FROM memberships WHERE start_date <= DATE '2001-06-30' AND (end_date IS NULL OR DATE '1996-01-01' < end_date) GROUP BY symbol""",
    "seeds": """
  SELECT DISTINCT f.symbol, t.seed_key FROM folded f JOIN tickers t ON t.scheme = 'listing' AND t.ticker = f.symbol AND t.valid_from <= DATE '2001-06-30' AND (t.valid_to IS NULL OR f.e0 < t.valid_to)""",
    "others": """
  SELECT s.symbol, t.ticker AS name, MIN(t.ord) AS at FROM seeds s JOIN folded f ON f.symbol = s.symbol JOIN tickers t ON t.scheme = 'vendor' AND t.seed_key = s.seed_key AND t.ticker <> s.symbol
    AND t.valid_from <= DATE '2001-06-30' AND (t.valid_to IS NULL OR f.e0 < t.valid_to) GROUP BY ALL""",
    "base": """
  SELECT f.*, COALESCE((SELECT arg_min(o.name, o.at) FROM others o WHERE o.symbol = f.symbol), f.symbol) AS vendor_symbol,
         (SELECT CASE WHEN COUNT(*) = 1 THEN MIN(t.seed_key) END FROM tickers t WHERE t.scheme = 'listing' AND t.ticker = f.symbol AND t.valid_from <= f.e0 AND (t.valid_to IS NULL OR f.e0 < t.valid_to)) AS seed_key,
         w.f AS own0, w.l AS own1,
         COALESCE((SELECT arg_min(x.f, o.at) FROM others o JOIN win x ON x.symbol = o.name WHERE o.symbol = f.symbol), w.f) AS p0,
         COALESCE((SELECT arg_min(x.l, o.at) FROM others o JOIN win x ON x.symbol = o.name WHERE o.symbol = f.symbol), w.l) AS p1
  FROM folded f LEFT JOIN win w ON w.symbol = f.symbol""",
    "facts": """
  SELECT b.*, date_diff('day', e0, e1) AS expected_days, s.status AS listing_status, b.seed_key IS NOT NULL AS resolved,
         (SELECT COUNT(*) FROM tickers t WHERE t.scheme = 'vendor' AND t.ticker = b.vendor_symbol AND t.valid_from <= e0 AND (t.valid_to IS NULL OR e0 < t.valid_to)) = 1 AS vendor_ok,
         (SELECT COUNT(*) FROM tickers t WHERE t.scheme = 'vendor' AND t.ticker = b.vendor_symbol AND t.valid_from <= p0 AND (t.valid_to IS NULL OR p0 < t.valid_to)) = 1 AS vendor_first_ok,
         (SELECT COUNT(DISTINCT t.seed_key) FROM tickers t WHERE t.scheme = 'listing' AND t.ticker = b.symbol AND t.valid_from <= DATE '2001-06-30' AND (t.valid_to IS NULL OR DATE '1996-01-01' < t.valid_to)) > 1 AS recycled,
         (SELECT COUNT(DISTINCT t.ticker) FROM tickers t WHERE t.scheme = 'listing' AND t.seed_key = b.seed_key) > 1 AS renamed,
         (SELECT arg_min(t.valid_from, t.ord) FROM tickers t WHERE t.scheme = 'vendor' AND t.ticker = b.vendor_symbol AND t.seed_key = b.seed_key) AS v0,
         (SELECT arg_min(COALESCE(t.valid_to, DATE '9999-12-31'), t.ord) FROM tickers t WHERE t.scheme = 'vendor' AND t.ticker = b.vendor_symbol AND t.seed_key = b.seed_key) AS v1,
         own0 IS NOT NULL AND own0 < e1 AND own1 + 1 > e0 AS own_touches
  FROM base b LEFT JOIN securities s ON s.seed_key = b.seed_key""",
    "measured": """
  SELECT *, resolved AND NOT vendor_ok AND own_touches AS failed,
         CASE WHEN p0 IS NULL OR (resolved AND NOT vendor_ok AND own_touches) OR (resolved AND v0 IS NULL AND NOT vendor_first_ok) THEN 0
              ELSE GREATEST(0, date_diff('day', GREATEST(p0, COALESCE(v0, p0), e0), LEAST(p1 + 1, COALESCE(v1, p1 + 1), e1))) END AS coverage_days
  FROM facts""",
    "coverage": """
  SELECT *, coverage_days / expected_days AS ratio,
    CASE WHEN failed THEN 'H_identity_validation_failed' WHEN recycled AND coverage_days <= 0 THEN 'C_ticker_recycled'
         WHEN vendor_symbol <> symbol AND p0 IS NOT NULL AND coverage_days > 0 THEN 'G_data_under_other_ticker'
         WHEN vendor_symbol <> symbol AND p0 IS NULL THEN 'B_ticker_change' WHEN renamed AND coverage_days <= 0 THEN 'B_ticker_change'
         WHEN listing_status = 'DELISTED' AND coverage_days > 0 THEN 'F_delisted' WHEN listing_status = 'DELISTED' AND own0 >= e1 THEN 'C_ticker_recycled'
         WHEN listing_status = 'DELISTED' THEN 'A_unavailable' WHEN coverage_days <= 0 AND NOT resolved THEN 'D_unresolved_identity'
         WHEN coverage_days <= 0 THEN 'I_insufficient_evidence' WHEN NOT resolved THEN 'D_unresolved_identity'
         WHEN coverage_days < expected_days THEN 'I_insufficient_evidence' ELSE '' END AS reason,
    CASE WHEN failed OR (recycled AND coverage_days <= 0 AND own_touches) THEN 'unusable' WHEN coverage_days <= 0 THEN 'not_applicable'
         WHEN coverage_days >= expected_days THEN 'valid' ELSE 'partial' END AS quality,
    CASE WHEN failed THEN 'unusable' WHEN coverage_days <= 0 THEN 'missing' WHEN coverage_days < expected_days THEN 'partial' WHEN vendor_symbol <> symbol THEN 'available_other_ticker' ELSE 'available' END AS market,
    CASE WHEN failed OR recycled AND coverage_days <= 0 OR vendor_symbol <> symbol AND p0 IS NOT NULL AND coverage_days > 0 THEN 'high'
         WHEN vendor_symbol <> symbol AND p0 IS NULL THEN CASE WHEN resolved THEN 'high' ELSE 'medium' END WHEN renamed AND coverage_days <= 0 THEN CASE WHEN resolved THEN 'high' ELSE 'low' END
         WHEN listing_status = 'DELISTED' THEN CASE WHEN resolved OR coverage_days > 0 OR own0 >= e1 THEN 'high' ELSE 'low' END WHEN coverage_days <= 0 THEN 'low'
         WHEN coverage_days < expected_days THEN CASE WHEN resolved THEN 'medium' ELSE 'low' END WHEN resolved THEN 'high' ELSE 'low' END AS confidence,
    symbol IN (SELECT m.symbol FROM memberships m JOIN generate_series(DATE '1997-01-01', DATE '2001-06-30', INTERVAL '1' MONTH) g(d)
               ON m.start_date <= CAST(g.d AS DATE) AND (m.end_date IS NULL OR CAST(g.d AS DATE) < m.end_date)) AS met
  FROM measured""",
}

_HISTORY = {
    "recycled": """SELECT ticker AS name, COUNT(DISTINCT seed_key) AS n FROM tickers WHERE scheme = 'listing' AND valid_from <= DATE '2001-06-30' AND (valid_to IS NULL OR DATE '1996-01-01' < valid_to)
                   GROUP BY ticker HAVING COUNT(DISTINCT seed_key) > 1""",
    "renamed": "SELECT seed_key AS name, COUNT(DISTINCT ticker) AS n FROM tickers WHERE scheme = 'listing' GROUP BY seed_key HAVING COUNT(DISTINCT ticker) > 1",
}


def _history(s: Standins) -> DataFrame:
    recycled, renamed = i.ticker_history(s.tickers, START, END)
    a = recycled.select(F.lit("recycled").alias("kind"), F.col("ticker").alias("name"), F.col("securities").alias("n"))
    return a.union(renamed.select(F.lit("renamed"), "seed_key", "tickers"))


def _retargeted(s: Standins) -> DataFrame:
    held = s.holdings.select("portfolio_id", "position_key", "symbol", "quantity", F.lit(None).cast("string").alias("security_id"), F.lit("old").alias("listing_id"))
    fresh = s.wanted.select(
        "portfolio_id", "position_key", F.concat("symbol", F.lit("N")).alias("symbol"), F.col("position_key").alias("security_id"),
        F.when(F.col("symbol") != "S000004", F.lit("new")).alias("listing_id"),
    )
    return i.retarget_listings(held, fresh)


QUERIES: dict[str, Query] = {
    "resolved_bars": Query(
        _resolved,
        T(
            "bars tickers",
            """SELECT ls.ticker AS symbol, ls.d AS session, CASE WHEN ls.seed IS NULL THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS status, ls.seed AS seed_key,
                      CASE WHEN vs.seed IS NULL THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS vendor_status, vs.seed AS vendor_seed_key
               FROM ls JOIN vs ON ls.ticker = vs.ticker AND ls.d = vs.d""",
            {k: _SERIES[k] for k in ("ls", "vs")},
        ),
        "J06 J07 D5 D6",
    ),
    "vendor_mapped": Query(
        lambda s: i.has_vendor_mapping(s.bars.select("symbol").distinct(), s.tickers, "symbol", SCHEME),
        T("bars tickers", "SELECT DISTINCT symbol FROM bars WHERE symbol IN (SELECT ticker FROM tickers WHERE scheme = 'vendor')"),
        "J07",
    ),
    "vendor_names": Query(
        lambda s: i.vendor_symbols(_requests(s), s.tickers, SCHEME).select(
            "listing", F.array_join("fetch_symbols", ",").alias("fetch_symbols"), "preferred_symbol"
        ),
        T("tickers", "SELECT listing, listing || COALESCE(',' || others, '') AS fetch_symbols, COALESCE(best, listing) AS preferred_symbol FROM names", _VENDOR_NAMES),
        "J08",
    ),
    "vendor_series": Query(
        _substituted,
        T(
            "bars tickers",
            """SELECT p.listing, p.vendor AS is_vendor, COUNT(*) AS bars, CAST(SUM(b.volume) AS BIGINT) AS volume
               FROM (SELECT n.listing, COALESCE(BOOL_OR(x.symbol IS NOT NULL), FALSE) AS vendor FROM names n
                     LEFT JOIN (SELECT DISTINCT symbol FROM stored) x ON x.symbol = n.best GROUP BY n.listing) p
               JOIN names n ON n.listing = p.listing JOIN stored b ON b.symbol = CASE WHEN p.vendor THEN n.best ELSE p.listing END GROUP BY ALL""",
            {
                **_VENDOR_NAMES,
                "stored": "SELECT symbol, session, volume FROM bars UNION ALL SELECT symbol || 'X', session, volume * 2 FROM bars WHERE symbol || 'X' IN (SELECT ticker FROM tickers WHERE scheme = 'vendor')",
            },
        ),
        "J09",
    ),
    "identity_clip": Query(
        _clipped,
        T(
            "bars tickers",
            """SELECT vs.ticker AS symbol, COUNT(*) AS bars, MIN(vs.d) AS first_session, MAX(vs.d) AS last_session
               FROM vs JOIN series s ON s.ticker = vs.ticker WHERE s.mismatch OR NOT s.has_vendor OR vs.seed IS NOT NULL GROUP BY vs.ticker""",
            _SERIES,
        ),
        "J10",
    ),
    "identity_mismatches": Query(
        lambda s: i.apply_identity(s.bars, s.tickers, SCHEME)[1],
        T("bars tickers", "SELECT ticker AS symbol, 'identity_mismatch' AS reason FROM series WHERE mismatch", _SERIES),
        "J10 P18",
    ),
    "member_identities": Query(
        _identity_sample,
        T(
            "memberships tickers",
            """SELECT d.symbol, d.on_day, CASE WHEN c.n = 1 THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS status, CASE WHEN c.n = 1 THEN c.seed END AS security_id,
                      '_:' || d.symbol || ':' || COALESCE(strftime(COALESCE(CASE WHEN c.n = 1 THEN c.since END, o.since), '%Y-%m-%d'), 'occupancy-unknown') AS listing_id,
                      CASE WHEN c.n = 1 THEN 'security:' || c.seed ELSE 'listing:_:' || d.symbol || ':' || COALESCE(strftime(COALESCE(CASE WHEN c.n = 1 THEN c.since END, o.since), '%Y-%m-%d'), 'occupancy-unknown') END AS position_key,
                      o.n > 1 AS occupancy_conflict
               FROM (SELECT symbol, start_date AS on_day FROM memberships UNION SELECT symbol, end_date FROM memberships WHERE end_date IS NOT NULL) d,
               LATERAL (SELECT COUNT(*) AS n, MIN(seed_key) AS seed, MIN(valid_from) AS since FROM tickers t WHERE t.scheme = 'listing' AND t.ticker = d.symbol AND t.valid_from <= d.on_day AND (t.valid_to IS NULL OR d.on_day < t.valid_to)) c,
               LATERAL (SELECT COUNT(*) AS n, MIN(start_date) AS since FROM memberships m WHERE m.symbol = d.symbol AND m.start_date <= d.on_day AND (m.end_date IS NULL OR d.on_day < m.end_date)) o""",
        ),
        "J11 L11 D7",
    ),
    "signal_identities": Query(
        _attached,
        T(
            "bars universe tickers memberships",
            """SELECT d.as_of, d.symbol, d.rank, CASE WHEN c.n = 1 THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS status, CASE WHEN c.n = 1 THEN c.seed END AS security_id,
                      '_:' || d.symbol || ':' || strftime(CASE WHEN c.n = 1 THEN c.since ELSE u.start_date END, '%Y-%m-%d') AS listing_id,
                      CASE WHEN c.n = 1 THEN 'security:' || c.seed ELSE 'listing:_:' || d.symbol || ':' || strftime(u.start_date, '%Y-%m-%d') END AS position_key
               FROM signals d JOIN universe u ON u.as_of = d.as_of AND u.symbol = d.symbol,
               LATERAL (SELECT COUNT(*) AS n, MIN(seed_key) AS seed, MIN(valid_from) AS since FROM tickers t WHERE t.scheme = 'listing' AND t.ticker = d.symbol AND t.valid_from <= d.as_of AND (t.valid_to IS NULL OR d.as_of < t.valid_to)) c""",
            signal_ctes(PARAMS),
        ),
        "J12 J32 L11",
    ),
    "known_terminations": Query(
        _terminated,
        T(
            "bars tickers securities",
            """SELECT e.symbol, e.last_bar, e.session, e.last_bar < e.session AND CASE WHEN a.n = 1 THEN a.gone ELSE COALESCE(b.gone, FALSE) END AS terminated
               FROM (SELECT symbol, make_date(year(session), CASE WHEN month(session) <= 6 THEN 7 ELSE 12 END, 1) AS session, MAX(session) AS last_bar FROM bars GROUP BY 1, 2) e,
               LATERAL (SELECT COUNT(*) AS n, COALESCE(BOOL_OR(s.status = 'DELISTED'), FALSE) AS gone FROM tickers t JOIN securities s USING (seed_key)
                        WHERE t.scheme = 'listing' AND t.ticker = e.symbol AND t.valid_from <= e.last_bar AND (t.valid_to IS NULL OR e.last_bar < t.valid_to)) a,
               LATERAL (SELECT BOOL_OR(s.status = 'DELISTED') AS gone FROM tickers t JOIN securities s USING (seed_key)
                        WHERE t.scheme = 'listing' AND t.ticker = e.symbol AND t.valid_from <= e.last_bar AND e.last_bar <= t.valid_to) b""",
        ),
        "J13",
    ),
    "ticker_history": Query(
        _history,
        T("tickers", "SELECT 'recycled' AS kind, name, n FROM recycled UNION ALL SELECT 'renamed', name, n FROM renamed", _HISTORY),
        "A16",
    ),
    "ticker_intervals": Query(
        lambda s: overlap_counts(s.tickers, ["scheme", "ticker"], "valid_from", "valid_to"),
        T(
            "tickers",
            """SELECT a.scheme, a.ticker, a.valid_from, a.valid_to, CAST(1 AS BIGINT) AS copies, COUNT(b.ticker) AS overlap_count, FALSE AS impossible
               FROM tickers a LEFT JOIN tickers b ON a.scheme = b.scheme AND a.ticker = b.ticker AND a.valid_from <> b.valid_from
                    AND a.valid_from < COALESCE(b.valid_to, DATE '9999-12-31') AND b.valid_from < COALESCE(a.valid_to, DATE '9999-12-31') GROUP BY ALL""",
        ),
        "W12 P10",
    ),
    "retargeted_positions": Query(
        _retargeted,
        T(
            "holdings wanted",
            """SELECT h.portfolio_id, h.position_key, CASE WHEN w.symbol IS NULL OR w.symbol = 'S000004' THEN h.symbol ELSE w.symbol || 'N' END AS symbol, CAST(h.quantity AS BIGINT) AS quantity,
                      CASE WHEN w.symbol IS NULL OR w.symbol = 'S000004' THEN NULL ELSE w.position_key END AS security_id,
                      CASE WHEN w.symbol IS NULL OR w.symbol = 'S000004' THEN 'old' ELSE 'new' END AS listing_id
               FROM holdings h LEFT JOIN wanted w USING (portfolio_id, position_key)""",
        ),
        "J17",
    ),
    "pit_coverage": Query(
        lambda s: _coverage(s).select(
            "seed_key", "historical_ticker", "pit_start", "pit_end", "pit_intervals", "identity_status", "vendor_symbol", "price_start", "price_end",
            "coverage_days", "expected_days", "coverage_ratio", "quality_status", "reason", "rebalance_encountered", "local_listing",
            "market_data_status", "confidence",
        ),
        T(
            "memberships bars tickers securities",
            """SELECT seed_key, symbol AS historical_ticker, pit_start, pit_end, pit_intervals, CASE WHEN resolved THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS identity_status,
                      vendor_symbol, p0 AS price_start, p1 AS price_end, coverage_days, expected_days, ratio AS coverage_ratio, quality AS quality_status, reason,
                      met AS rebalance_encountered, own0 IS NOT NULL AS local_listing, market AS market_data_status, confidence FROM coverage""",
            _COVERAGE,
        ),
        "J19 J20 A15 A16 A17 S19",
    ),
    "pit_coverage_totals": Query(
        lambda s: coverage_totals(_coverage(s)),
        T(
            "memberships bars tickers securities",
            """SELECT COUNT(*) AS pit_securities, COUNT(*) FILTER (WHERE met) AS rebalance_encountered, COUNT(*) FILTER (WHERE ratio > 0 AND quality <> 'unusable') AS valid_data,
                      COUNT(*) FILTER (WHERE ratio <= 0) AS missing, COUNT(*) FILTER (WHERE ratio > 0 AND ratio < 1) AS partial, COUNT(*) FILTER (WHERE quality = 'unusable') AS unusable,
                      COUNT(*) FILTER (WHERE NOT resolved) AS unresolved_identity, COUNT(*) FILTER (WHERE own0 IS NULL) AS window_missing_listing,
                      COUNT(*) FILTER (WHERE own0 IS NULL AND met) AS rebalance_missing_listing FROM coverage""",
            _COVERAGE,
        ),
        "A15",
    ),
}
