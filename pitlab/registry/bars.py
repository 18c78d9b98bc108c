"""Reading, checking, merging, importing and describing bars."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlab.functions.checks import format_issue, issues, table_rules
from pitlab.functions.prices import price_for_role
from pitlab.operators.dedupe import dedupe_bars, merge_bars, upsert_bars
from pitlab.plans import imports, quality
from pitlab.registry import Query
from pitlab.schemas import BAR_TEXT_COLUMNS
from pitlab.session import materialize, shared_folder
from pitlab.sources.bars import (
    discover_symbols,
    load_history,
    normalize_raw_rows,
    parse_bars,
    read_bars_csv,
    read_bars_lenient,
    read_symbol_files,
    stored_extents,
    write_bars,
    write_by_symbol,
    write_symbol_files,
)
from pitlab.sources.tables import latest_bars, missing_stocks, with_stock
from pitlab.sources.vendor import normalize_vendor_bars
from pitlab.standins.frames import Standins, ticker
from pitlab.standins.sql import with_tables as T

PRICES = ("open", "high", "low", "close", "adjusted_close")
START, END = date(1996, 1, 1), date(2000, 12, 31)


def doubles(df: DataFrame) -> DataFrame:
    """Decimals as doubles, ints as longs: types that both engines print alike."""
    widen = {"decimal": "double", "int": "long", "float": "double"}
    return df.select(
        *[F.col(f.name).cast(widen.get(f.dataType.simpleString().split("(")[0], f.dataType.simpleString())).alias(f.name) for f in df.schema.fields]
    )


def _parsed(s: Standins, strict: bool = False) -> DataFrame:
    return parse_bars(s.raw_bars, strict=strict, fatal=False)


def _issue_counts(s: Standins, strict: bool) -> DataFrame:
    each = _parsed(s, strict).select("symbol", F.explode("issues").alias("issue"))
    return each.groupBy("symbol", "issue").agg(F.count(F.lit(1)).alias("n"))


_LAX_RULES = """
  SELECT symbol, 'timestamp must be timezone-aware' AS issue, naive AS bad FROM raw_bars
  UNION ALL SELECT symbol, 'high must be >= low', high < low FROM raw_bars
  UNION ALL SELECT symbol, 'high must be >= open', high < open FROM raw_bars
  UNION ALL SELECT symbol, 'high must be >= close', high < close FROM raw_bars
  UNION ALL SELECT symbol, 'low must be <= open', low > open FROM raw_bars
  UNION ALL SELECT symbol, 'low must be <= close', low > close FROM raw_bars
  UNION ALL SELECT symbol, 'volume must be non-negative', volume < 0 FROM raw_bars"""
_STRICT_RULES = _LAX_RULES + """
  UNION ALL SELECT symbol, 'adjusted_close is required', adjusted_close IS NULL FROM raw_bars"""


def _rejects(s: Standins) -> DataFrame:
    bad = _parsed(s).filter(F.size("issues") > 0)
    message = format_issue(F.element_at("issues", 1), F.col("row_number"), F.col("symbol"), F.col("ts"), F.col("source"))
    return bad.select("source", message.alias("message"), F.size("issues").cast("long").alias("n_issues"))


def _good(s: Standins) -> DataFrame:
    return _checked(_parsed(s))


def _deduped(s: Standins) -> DataFrame:
    kept = dedupe_bars(_good(s), ["source", "row_number"], count_as="copies")
    return doubles(kept.select("symbol", "session", "close", "adjusted_close", "volume", "source", "copies"))


_FIRST = {
    "first_bars": """
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol, ts ORDER BY source, row_number) AS k,
                        COUNT(*) OVER (PARTITION BY symbol, ts) AS copies FROM raw_bars WHERE n_issues = 0) q WHERE k = 1"""
}


def _feeds(s: Standins, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(stored, incoming): the returned feed is stored, the others arrive unchecked. The texts are parsed once, for both.

    Of the stored bars only ``columns`` are given, if any are named; then no others are shuffled.
    """
    tagged = materialize(parse_bars(s.raw_bars, fatal=False, carry=["feed"]), "parsed")
    good = tagged.filter((F.col("feed") == "R") & (F.size("issues") == 0)).drop("feed", "issues")
    order = ["source", "row_number"]
    stored = dedupe_bars(good.select(*columns, *order) if columns else good, order)
    return (stored.select(*columns) if columns else stored), tagged.filter(F.col("feed") != "R").drop("feed")


def _stock(s: Standins) -> tuple[DataFrame, DataFrame]:
    """``_feeds`` for imports, which read the stored bars more than once, but only their keys and sessions: these are written."""
    stored, incoming = _feeds(s, "symbol", "ts", "session")
    return materialize(stored, "stored-keys"), incoming


def _checked(rows: DataFrame) -> DataFrame:
    return rows.filter(F.size("issues") == 0).drop("issues")


def _merged(s: Standins) -> DataFrame:
    stored, incoming = _feeds(s)
    merged = merge_bars(stored, _checked(incoming), order=("source", "row_number"))
    return doubles(merged.select("symbol", "session", "close", "volume", "source"))


def _appended(s: Standins) -> DataFrame:
    stored, incoming = _feeds(s)
    return upsert_bars(stored, _checked(incoming), ["source", "row_number"])[1]


_FEEDS = {
    "feeds": """SELECT *, CASE WHEN feed = 'R' THEN 0 ELSE 1 END AS grp FROM raw_bars WHERE n_issues = 0""",
}


def _requests(s: Standins) -> DataFrame:
    """Every supplier asks for a range that depends on it."""
    shift = F.col("s_suppkey").cast("int") % 7
    return s.table("supplier").select(
        ticker("s_suppkey").alias("symbol"),
        F.date_add(F.lit(date(1994, 12, 20)), shift * 60).alias("start"),
        F.date_sub(F.lit(date(2001, 12, 31)), shift * 90).alias("end"),
    )


_REQUESTS = {
    "requests": """
  SELECT printf('S%06d', s_suppkey) AS symbol, CAST(DATE '1994-12-20' + CAST(s_suppkey % 7 * 60 AS INTEGER) AS DATE) AS start,
         CAST(DATE '2001-12-31' - CAST(s_suppkey % 7 * 90 AS INTEGER) AS DATE) AS "end" FROM supplier"""
}


def _import(s: Standins, strict: bool) -> DataFrame:
    stored, incoming = _stock(s)
    return imports.import_bars(incoming, stored, _requests(s), strict=strict)[1]


def _stored_import(s: Standins) -> DataFrame:
    """New bars as they are stored, with the count that was observed while they were written."""
    stored, incoming = _stock(s)
    path = _folder(s, "imported")
    _, seen = imports.store_import(incoming, stored, _requests(s), path)
    back = s.spark.read.parquet(path)
    return doubles(back.select("symbol", "session", "close", "volume", "source", F.lit(seen["bars"]).alias("bars_written")))


def _import_ctes(strict: bool) -> dict[str, str]:
    cut = """date_diff('day', start, "end") >= 365 AND (first_date IS NULL OR first_date > start + 10 OR last_date < "end" - 10)"""
    few = """bars_stored < CASE WHEN date_diff('day', start, "end") < 365 THEN 0 ELSE GREATEST(252, date_diff('day', start, "end") // 2) END"""
    fail, warn = (f"({few}) OR ({cut})", "invalid_rows > 0") if strict else ("FALSE", f"invalid_rows > 0 OR ({cut})")
    return {
        **_REQUESTS,
        "stored": "SELECT DISTINCT r.symbol, r.ts, r.session, q.start, q.\"end\" FROM raw_bars r JOIN requests q USING (symbol) WHERE feed = 'R' AND n_issues = 0",
        "state": """
  SELECT q.symbol, q.start, q."end", MIN(s.session) AS old_first, MAX(s.session) AS old_last, COUNT(s.session) AS old_bars
  FROM requests q LEFT JOIN stored s ON s.symbol = q.symbol AND s.session BETWEEN q.start AND q."end" GROUP BY ALL""",
        "states": """SELECT *, NOT (old_first IS NULL OR old_first > start + 10 OR old_last < "end" - 10) AS covered FROM state""",
        "arrived": """
  SELECT r.* FROM raw_bars r JOIN states q ON q.symbol = r.symbol AND NOT q.covered WHERE r.feed <> 'R' AND r.session BETWEEN q.start AND q."end" """,
        "stamps": """
  SELECT a.symbol, a.ts, a.session, COUNT(*) AS copies, EXISTS (SELECT 1 FROM stored s WHERE s.symbol = a.symbol AND s.ts = a.ts) AS old
  FROM arrived a WHERE n_issues = 0 GROUP BY a.symbol, a.ts, a.session""",
        "joined": """
  SELECT q.*, COALESCE(a.rows_read, 0) AS rows_read, COALESCE(a.invalid_rows, 0) AS invalid_rows, COALESCE(t.uniq, 0) AS uniq,
         COALESCE(t.inserted, 0) AS rows_inserted, COALESCE(t.dups, 0) AS dups,
         LEAST(q.old_first, t.new_first) AS first_date, GREATEST(q.old_last, t.new_last) AS last_date, q.old_bars + COALESCE(t.inserted, 0) AS bars_stored
  FROM states q
  LEFT JOIN (SELECT symbol, COUNT(*) AS rows_read, COUNT(*) FILTER (WHERE n_issues > 0) AS invalid_rows FROM arrived GROUP BY symbol) a ON a.symbol = q.symbol
  LEFT JOIN (SELECT symbol, COUNT(*) AS uniq, COUNT(*) FILTER (WHERE NOT old) AS inserted, CAST(SUM(copies) AS BIGINT) - COUNT(*) FILTER (WHERE NOT old) AS dups,
                    MIN(session) FILTER (WHERE NOT old) AS new_first, MAX(session) FILTER (WHERE NOT old) AS new_last
             FROM stamps GROUP BY symbol) t ON t.symbol = q.symbol""",
        "summary": f"""
  SELECT symbol, rows_read, rows_inserted, CASE WHEN covered THEN old_bars ELSE dups END AS duplicates, invalid_rows, first_date, last_date, bars_stored,
         CASE WHEN covered THEN 'SUCCESS' WHEN rows_read = 0 THEN 'EMPTY' WHEN uniq = 0 THEN 'FAILED' WHEN {fail} THEN 'FAILED'
              WHEN {warn} THEN 'SUCCESS_WITH_WARNINGS' WHEN dups > 0 AND rows_inserted = 0 THEN 'SUCCESS' WHEN dups > 0 THEN 'SUCCESS_WITH_WARNINGS'
              ELSE 'SUCCESS' END AS status,
         CASE WHEN covered THEN 'DATABASE' WHEN rows_read = 0 THEN 'EMPTY' WHEN uniq = 0 THEN 'FAILED' ELSE 'DOWNLOADED' END AS origin
  FROM joined""",
    }


def _coverage(s: Standins) -> DataFrame:
    asked = s.table("part").select(F.concat(ticker("p_partkey")).alias("symbol"))
    return doubles(quality.market_data_coverage(asked, s.bars, START, END, 252))


def _roles(s: Standins) -> DataFrame:
    return doubles(
        s.bars.select(
            "symbol",
            "session",
            *[price_for_role(r).alias(r.lower()) for r in ("EXECUTION", "MARK", "TERMINAL", "SIGNAL")],
            price_for_role("SIGNAL").isNull().alias("signal_missing"),
        )
    )


def _vendor_records(s: Standins) -> DataFrame:
    """Vendor records: open, high or low may be blank and the volume unreadable."""
    raw = s.table("lineitem").select(
        ticker("l_suppkey").alias("symbol"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("Date"),
        F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).otherwise("").alias("Open"),
        F.when(F.col("l_linenumber") != 4, F.lit("200000.5")).otherwise("nan").alias("High"),
        F.lit(None).cast("string").alias("Low"),
        F.when(F.col("l_linenumber") != 5, (F.col("l_extendedprice").cast("decimal(18,2)") / 2).cast("decimal(18,3)").cast("string")).otherwise("None").alias("Close"),
        F.when(F.col("l_linenumber") != 6, F.col("l_quantity").cast("string")).otherwise("many").alias("Volume"),
    )
    bars = normalize_vendor_bars(raw, adjusted=True)
    return bars.groupBy("symbol", "session").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).cast("double").alias(f"sum_{c}") for c in ("open", "high", "low", "close", "adjusted_close", "volume")],
    )


def _raw_rows(s: Standins) -> DataFrame:
    raw = s.table("lineitem").select(
        ticker("l_suppkey").alias("symbol"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
        *[
            F.when(F.col("l_linenumber") == k, F.lit("NaN")).otherwise(F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).alias(c)
            for c, k in (("open", 1), ("high", 0), ("low", 0), ("close", 0))
        ],
        F.when(F.col("l_discount") == 0, "").otherwise(F.col("l_extendedprice").cast("string")).alias("adjusted_close"),
        F.when(F.col("l_linenumber") == 2, F.col("l_quantity") + 0.5).otherwise(F.col("l_quantity")).alias("volume"),
    )
    parsed = normalize_raw_rows(raw)
    first = F.when(F.size("issues") == 0, "ok").otherwise(F.element_at("issues", 1))
    return parsed.groupBy("symbol", first.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def _constraints(s: Standins) -> DataFrame:
    rows = s.orders.withColumnRenamed("position_key", "symbol").select(
        F.when(F.col("quantity") == 1, "").otherwise(F.col("symbol")).alias("symbol"),
        "side",
        (F.col("quantity") - 2).alias("quantity"),
        F.when(F.col("side") == "BUY", "LIMIT").otherwise("MARKET").alias("order_type"),
        F.col("market_price").alias("limit_price"),
        F.when(F.col("quantity") == 7, "UNKNOWN").otherwise("CREATED").alias("status"),
    )
    found = rows.select(F.explode(issues(table_rules("orders"))).alias("issue"))
    return found.groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def _folder(s: Standins, name: str) -> str:
    return f"{shared_folder(s.spark)}/pitlab/{name}-{uuid.uuid4().hex}"


def _csv_scan(s: Standins) -> DataFrame:
    """Bars written as CSV and read back by the strict scan."""
    path = _folder(s, "csv")
    write_bars(s.bars, path, "csv")
    read = read_bars_csv(s.spark, path, start=START, end=END)[0]
    return doubles(read.drop("ts"))


def _symbol_files(s: Standins) -> DataFrame:
    """Bars written as one file per symbol, found by the names of the files and read back."""
    path = _folder(s, "symbols")
    write_symbol_files(s.bars, path)
    read = parse_bars(read_symbol_files(s.spark, path)).join(discover_symbols(s.spark, path), "symbol", "left_semi")
    return doubles(read.select("symbol", "session", *PRICES, "volume", "row_number"))


def _lenient_scan(s: Standins) -> DataFrame:
    """Raw lines in files, in the order of their source texts; every fifth line of an order has a price that is none."""
    path = _folder(s, "cache")
    fifth = F.split("source", "-")[1] == "5"
    cells = s.raw_bars.withColumn("close", F.when(fifth, "n/a").otherwise(F.col("close")))
    cells = cells.repartitionByRange("source").sortWithinPartitions("source").select(*BAR_TEXT_COLUMNS)
    cells.write.option("header", "true").option("emptyValue", "").csv(path)
    return doubles(read_bars_lenient(s.spark, path).drop("ts"))


def _stocks(s: Standins) -> DataFrame:
    nation = s.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("exchange"))
    return s.table("supplier").join(nation, "s_nationkey").select(ticker("s_suppkey").alias("symbol"), "exchange")


def _by_symbol(s: Standins) -> str:
    path = _folder(s, "bars-by-symbol")
    write_by_symbol(s.bars, path)
    return path


QUERIES: dict[str, Query] = {
    "daily_bars": Query(
        lambda s: doubles(s.bars.drop("ts")),
        T("bars", "SELECT symbol, session, open::DOUBLE AS open, high::DOUBLE AS high, low::DOUBLE AS low, close::DOUBLE AS close, adjusted_close::DOUBLE AS adjusted_close, volume FROM bars"),
        "S06 D1",
    ),
    "bar_issues": Query(
        lambda s: _issue_counts(s, False),
        T("raw_bars", "SELECT symbol, issue, COUNT(*) AS n FROM rules WHERE bad GROUP BY symbol, issue", {"rules": _LAX_RULES}),
        "P01 P02 P03 S04",
    ),
    "strict_bar_issues": Query(
        lambda s: _issue_counts(s, True),
        T("raw_bars", "SELECT symbol, issue, COUNT(*) AS n FROM rules WHERE bad GROUP BY symbol, issue", {"rules": _STRICT_RULES}),
        "P04",
    ),
    "reject_messages": Query(
        _rejects,
        T(
            "raw_bars",
            """SELECT source, CASE WHEN naive THEN 'timestamp must be timezone-aware' WHEN high < low THEN 'high must be >= low' ELSE 'volume must be non-negative' END
                      || ' row=' || row_number || ' symbol=' || symbol || ' timestamp=' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00 source=' || source AS message,
                      CAST(n_issues AS BIGINT) AS n_issues
               FROM raw_bars WHERE n_issues > 0""",
        ),
        "P05 S01",
    ),
    "deduplicated_bars": Query(
        _deduped,
        T("raw_bars", "SELECT symbol, session, close::DOUBLE AS close, adjusted_close::DOUBLE AS adjusted_close, volume, source, copies FROM first_bars", _FIRST),
        "W05",
    ),
    "merged_bars": Query(
        _merged,
        T(
            "raw_bars",
            """SELECT symbol, session, close::DOUBLE AS close, volume, source FROM (
                 SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol, ts ORDER BY grp, source, row_number) AS k FROM feeds) q WHERE k = 1""",
            _FEEDS,
        ),
        "U01",
    ),
    "appended_bars": Query(
        _appended,
        T(
            "raw_bars",
            """SELECT symbol, CAST(SUM(copies) AS BIGINT) AS rows_read, COUNT(*) FILTER (WHERE NOT old) AS inserted,
                      CAST(SUM(copies) - COUNT(*) FILTER (WHERE NOT old) AS BIGINT) AS duplicates
               FROM (SELECT symbol, ts, COUNT(*) FILTER (WHERE grp = 1) AS copies, BOOL_OR(grp = 0) AS old FROM feeds GROUP BY symbol, ts) q
               WHERE copies > 0 GROUP BY symbol""",
            _FEEDS,
        ),
        "S08",
    ),
    "latest_bars": Query(
        lambda s: doubles(latest_bars(s.bars).drop("ts")),
        T(
            "bars",
            """SELECT symbol, session, open::DOUBLE AS open, high::DOUBLE AS high, low::DOUBLE AS low, close::DOUBLE AS close, adjusted_close::DOUBLE AS adjusted_close, volume
               FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY session DESC) AS k FROM bars) q WHERE k = 1""",
        ),
        "S07 A01",
    ),
    "price_windows": Query(
        lambda s: doubles(quality.price_windows(s.bars)),
        T("price_windows", "SELECT symbol, first_date, last_date, first_close::DOUBLE AS first_close, last_close::DOUBLE AS last_close, bars FROM price_windows"),
        "S25 D13 A01",
    ),
    "stored_extents": Query(
        lambda s: stored_extents(s.spark, _by_symbol(s)),
        T("price_windows", "SELECT symbol, first_date, last_date, bars FROM price_windows"),
        "S25 A01",
    ),
    "bar_gaps": Query(
        lambda s: doubles(quality.bar_gaps(s.bars, 14)),
        T(
            "bars",
            """SELECT symbol, previous, session, date_diff('day', previous, session) AS days
               FROM (SELECT symbol, session, LAG(session) OVER (PARTITION BY symbol ORDER BY session) AS previous FROM bars) q
               WHERE date_diff('day', previous, session) > 14""",
        ),
        "W04",
    ),
    "bar_quality": Query(
        lambda s: quality.bar_quality(_parsed(s)).drop("symbol"),
        T(
            "raw_bars",
            """SELECT CASE WHEN GROUPING(symbol) = 1 THEN 'total' ELSE symbol END AS level, CAST(SUM(n) AS BIGINT) AS bar_count, MIN(ts) AS first_timestamp, MAX(ts) AS last_timestamp,
                      CAST(SUM(n - 1) AS BIGINT) AS duplicates, CAST(SUM(no_adj) AS BIGINT) AS missing_adjusted_close, CAST(SUM(bad_px) AS BIGINT) AS non_positive_price,
                      CAST(SUM(bad_vol) AS BIGINT) AS non_positive_volume, COUNT(*) FILTER (WHERE gap) AS suspicious_gaps
               FROM (SELECT symbol, ts, n, no_adj, bad_px, bad_vol, COALESCE(date_diff('day', LAG(session) OVER (PARTITION BY symbol ORDER BY session), session) > 5, FALSE) AS gap
                     FROM (SELECT symbol, ts, session, COUNT(*) AS n, COUNT(*) FILTER (WHERE adjusted_close IS NULL) AS no_adj,
                                  COUNT(*) FILTER (WHERE open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 OR COALESCE(adjusted_close <= 0, FALSE)) AS bad_px,
                                  COUNT(*) FILTER (WHERE volume <= 0) AS bad_vol FROM raw_bars GROUP BY symbol, ts, session) d) e
               GROUP BY GROUPING SETS ((symbol), ())""",
        ),
        "A09",
    ),
    "market_data_coverage": Query(
        lambda s: _coverage(s).drop("symbol"),
        T(
            "bars",
            """SELECT CASE WHEN GROUPING(p.symbol) = 1 THEN 'total' ELSE p.symbol END AS level, MIN(first_date) AS first_date, MAX(last_date) AS last_date,
                      CAST(SUM(COALESCE(n, 0)) AS BIGINT) AS row_count, CAST(SUM(COALESCE(no_adj, 0)) AS BIGINT) AS missing_adjusted_close,
                      CASE WHEN GROUPING(p.symbol) = 0 THEN MIN(CASE WHEN n > 0 THEN 'available' ELSE 'missing' END) END AS download_status,
                      COUNT(*) AS symbols, COUNT(*) FILTER (WHERE n > 0) AS with_prices, COUNT(*) FILTER (WHERE n IS NULL) AS without_prices,
                      COUNT(*) FILTER (WHERE first_date > DATE '1996-01-11' OR last_date < DATE '2000-12-21') AS incomplete_range,
                      COUNT(*) FILTER (WHERE n < 253) AS insufficient_history
               FROM (SELECT DISTINCT printf('S%06d', p_partkey) AS symbol FROM part) p
               LEFT JOIN (SELECT symbol, MIN(session) AS first_date, MAX(session) AS last_date, COUNT(*) AS n, COUNT(*) FILTER (WHERE adjusted_close IS NULL) AS no_adj
                          FROM bars WHERE session BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' GROUP BY symbol) b ON b.symbol = p.symbol
               GROUP BY ROLLUP (p.symbol)""",
        ),
        "A10",
    ),
    "import_plan": Query(
        lambda s: imports.import_plan(quality.price_windows(s.bars), _requests(s)),
        T(
            "price_windows",
            """SELECT q.symbol, q.start, q."end", action, CASE WHEN action <> 'cached' THEN start END AS fetch_start,
                      CASE WHEN action = 'full' THEN "end" WHEN action = 'prefix' THEN LEAST("end", first_date - 1) END AS fetch_end,
                      COALESCE(first_date <= start + 10 AND last_date >= "end" - 10, FALSE) AS covers_range
               FROM (SELECT r.*, w.first_date, w.last_date, CASE WHEN w.first_date IS NULL THEN 'full' WHEN w.first_date <= r.start + 10 THEN 'cached'
                            WHEN LEAST(r."end", w.first_date - 1) < r.start THEN 'cached' ELSE 'prefix' END AS action
                     FROM requests r LEFT JOIN price_windows w USING (symbol)) q""",
            _REQUESTS,
        ),
        "S26 S27",
    ),
    "stored_import_plan": Query(
        lambda s: imports.import_plan(stored_extents(s.spark, _by_symbol(s)), _requests(s)),
        T(
            "price_windows",
            """SELECT q.symbol, q.start, q."end", action, CASE WHEN action <> 'cached' THEN start END AS fetch_start,
                      CASE WHEN action = 'full' THEN "end" WHEN action = 'prefix' THEN LEAST("end", first_date - 1) END AS fetch_end,
                      COALESCE(first_date <= start + 10 AND last_date >= "end" - 10, FALSE) AS covers_range
               FROM (SELECT r.*, w.first_date, w.last_date, CASE WHEN w.first_date IS NULL THEN 'full' WHEN w.first_date <= r.start + 10 THEN 'cached'
                            WHEN LEAST(r."end", w.first_date - 1) < r.start THEN 'cached' ELSE 'prefix' END AS action
                     FROM requests r LEFT JOIN price_windows w USING (symbol)) q""",
            _REQUESTS,
        ),
        "S26 S25",
    ),
    "import_summary": Query(
        lambda s: _import(s, strict=True), T("raw_bars", "SELECT * FROM summary", _import_ctes(True)), "S27 S08"
    ),
    "stored_import": Query(
        _stored_import,
        T(
            "raw_bars",
            """SELECT symbol, session, close, volume, source, COUNT(*) OVER () AS bars_written
               FROM (SELECT a.symbol, a.session, a.close::DOUBLE AS close, a.volume, a.source, t.old, ROW_NUMBER() OVER (PARTITION BY a.symbol, a.ts ORDER BY a.source, a.row_number) AS k
                     FROM arrived a JOIN stamps t ON t.symbol = a.symbol AND t.ts = a.ts WHERE a.n_issues = 0) q WHERE k = 1 AND NOT old""",
            _import_ctes(True),
        ),
        "S27 S08 A09",
    ),
    "import_report": Query(
        lambda s: imports.import_report(_import(s, strict=False)),
        T(
            "raw_bars",
            """SELECT COUNT(*) AS symbols, COUNT(*) FILTER (WHERE origin = 'DOWNLOADED') AS downloaded, COUNT(*) FILTER (WHERE origin = 'CACHED') AS cached,
                      COUNT(*) FILTER (WHERE origin = 'DATABASE') AS already_stored, COUNT(*) FILTER (WHERE status = 'FAILED') AS failed,
                      COUNT(*) FILTER (WHERE status = 'EMPTY') AS empty, CAST(SUM(rows_inserted) AS BIGINT) AS rows_inserted, CAST(SUM(duplicates) AS BIGINT) AS duplicates_skipped
               FROM summary""",
            _import_ctes(False),
        ),
        "A18 S27",
    ),
    "history_with_warmup": Query(
        lambda s: load_history(s.bars, date(1998, 1, 1), date(1999, 12, 31), 252).groupBy("symbol").agg(
            F.count(F.lit(1)).alias("n"), F.min("session").alias("first_session")
        ),
        T("bars", "SELECT symbol, COUNT(*) AS n, MIN(session) AS first_session FROM bars WHERE session BETWEEN DATE '1998-01-01' - 544 AND DATE '1999-12-31' GROUP BY symbol"),
        "S24 S06 P06",
    ),
    "price_roles": Query(
        _roles,
        T("bars", "SELECT symbol, session, open::DOUBLE AS execution, close::DOUBLE AS mark, close::DOUBLE AS terminal, adjusted_close::DOUBLE AS signal, adjusted_close IS NULL AS signal_missing FROM bars"),
        "P17",
    ),
    "vendor_records": Query(
        _vendor_records,
        """SELECT printf('S%06d', l_suppkey) AS symbol, CAST(l_shipdate AS DATE) AS session, COUNT(*) AS n,
                  CAST(SUM(CASE WHEN l_linenumber <> 3 THEN px ELSE c END) AS DOUBLE) AS sum_open,
                  CAST(SUM(CASE WHEN l_linenumber <> 4 THEN CAST(200000.5 AS DECIMAL(18,3)) ELSE c END) AS DOUBLE) AS sum_high, CAST(SUM(c) AS DOUBLE) AS sum_low,
                  CAST(SUM(c) AS DOUBLE) AS sum_close, CAST(SUM(c) AS DOUBLE) AS sum_adjusted_close,
                  CAST(SUM(CASE WHEN l_linenumber <> 6 THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS DOUBLE) AS sum_volume
           FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) AS px, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(0.5 AS DECIMAL(2,1)) AS DECIMAL(18,3)) AS c FROM lineitem) l
           WHERE l_linenumber <> 5 GROUP BY 1, 2""",
        "S21",
    ),
    "raw_row_outcomes": Query(
        _raw_rows,
        """SELECT printf('S%06d', l_suppkey) AS symbol, CASE WHEN l_linenumber IN (1, 2) THEN 'unparseable row' WHEN l_discount = 0 THEN 'adjusted_close is required' ELSE 'ok' END AS outcome,
                  COUNT(*) AS n FROM lineitem GROUP BY 1, 2""",
        "S22 P04",
    ),
    "order_constraints": Query(
        _constraints,
        T(
            "trades",
            """SELECT issue, COUNT(*) AS n FROM (
                 SELECT 'symbol must not be empty' AS issue, quantity = 1 AS bad FROM trades UNION ALL SELECT 'quantity must be > 0', quantity <= 2 FROM trades
                 UNION ALL SELECT 'LIMIT order requires limit_price', side = 'BUY' AND market_price IS NULL FROM trades
                 UNION ALL SELECT 'MARKET order must not have limit_price', side = 'SELL' AND market_price IS NOT NULL FROM trades
                 UNION ALL SELECT 'unknown status', quantity = 7 FROM trades) q WHERE bad GROUP BY issue""",
        ),
        "P21",
    ),
    "csv_scan": Query(
        _csv_scan,
        T(
            "bars",
            """SELECT symbol, session, open::DOUBLE AS open, high::DOUBLE AS high, low::DOUBLE AS low, close::DOUBLE AS close, adjusted_close::DOUBLE AS adjusted_close, volume
               FROM bars WHERE session BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""",
        ),
        "S01 S05 P06",
    ),
    "symbol_files": Query(
        _symbol_files,
        T(
            "bars",
            """SELECT symbol, session, open::DOUBLE AS open, high::DOUBLE AS high, low::DOUBLE AS low, close::DOUBLE AS close, adjusted_close::DOUBLE AS adjusted_close, volume,
                      1 + ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY ts) AS row_number FROM bars""",
        ),
        "S02 S03 S05",
    ),
    "lenient_scan": Query(
        _lenient_scan,
        T(
            "raw_bars",
            """SELECT symbol, session, open::DOUBLE AS open, high::DOUBLE AS high, low::DOUBLE AS low, close::DOUBLE AS close, adjusted_close::DOUBLE AS adjusted_close, volume
               FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol, ts ORDER BY source) AS k FROM raw_bars WHERE n_issues = 0 AND split_part(source, '-', 2) <> '5') q WHERE k = 1""",
        ),
        "S04 W05",
    ),
    "stock_dimension": Query(
        lambda s: with_stock(s.bars, _stocks(s)).groupBy("exchange").agg(
            F.count(F.lit(1)).alias("bars"), F.count_distinct("symbol").alias("symbols")
        ),
        T("bars", "SELECT n_name AS exchange, COUNT(*) AS bars, COUNT(DISTINCT symbol) AS symbols FROM bars JOIN supplier ON symbol = printf('S%06d', s_suppkey) JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name"),
        "J31 D16",
    ),
    "missing_stocks": Query(
        lambda s: missing_stocks(s.table("part").select(ticker("p_partkey").alias("symbol")), _stocks(s)),
        "SELECT printf('S%06d', p_partkey) AS symbol FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1",
        "J31 U02",
    ),
}
