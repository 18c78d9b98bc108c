"""Index membership: building, asking, comparing, checking."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlab.operators.intervals import overlap_counts, snapshots_to_intervals
from pitlab.plans import universe as u
from pitlab.registry import Query
from pitlab.session import shared_folder
from pitlab.sources.csvfiles import write_symbol_files as write_files
from pitlab.sources.tables import members_on, memberships_of
from pitlab.sources.universe import parse_snapshots, read_memberships
from pitlab.standins.frames import Standins, misfiled, ticker
from pitlab.standins.sql import with_tables as T

ASOF = date(1999, 6, 15)


def claims(s: Standins) -> DataFrame:
    """Intervals with copies, overlaps and inverted ranges: one per (supplier, part type, year)."""
    day = F.col("l_shipdate").cast("date")
    lines = s.table("lineitem").join(s.table("part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    spans = lines.groupBy(ticker("l_suppkey").alias("symbol"), "p_type", F.year(day).alias("y")).agg(
        F.min(day).alias("start_date"), F.max(day).alias("last"), F.count(F.lit(1)).alias("n")
    )
    end = F.when(F.col("n") % 13 == 0, F.date_sub("start_date", 3)).when((F.col("y") == 2001) & (F.col("n") % 2 == 0), F.lit(None)).otherwise(F.date_add("last", 1))
    copies = F.explode(F.sequence(F.lit(1), (F.col("n") % 3 + 1).cast("int")))
    return spans.select("symbol", "p_type", "start_date", end.cast("date").alias("end_date"), copies.alias("c")).drop("c")


_CLAIMS = {
    "claims": """
  SELECT symbol, p_type, start_date, CASE WHEN n % 13 = 0 THEN start_date - 3 WHEN y = 2001 AND n % 2 = 0 THEN NULL ELSE last + 1 END AS end_date
  FROM (SELECT printf('S%06d', l_suppkey) AS symbol, p_type, year(l_shipdate) AS y, MIN(CAST(l_shipdate AS DATE)) AS start_date,
               MAX(CAST(l_shipdate AS DATE)) AS last, COUNT(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3) q,
       range(1, 4) r(c) WHERE c <= n % 3 + 1""",
    "uniq": "SELECT symbol, start_date, end_date, COUNT(*) AS copies FROM claims GROUP BY ALL",
    "checked": """
  SELECT a.symbol, a.start_date, a.end_date, ANY_VALUE(a.copies) AS copies, COALESCE(a.start_date >= a.end_date, FALSE) AS impossible,
         COUNT(b.symbol) FILTER (WHERE (a.start_date <> b.start_date OR a.end_date IS DISTINCT FROM b.end_date)) AS overlap_count
  FROM uniq a LEFT JOIN uniq b ON a.symbol = b.symbol AND COALESCE(a.start_date < a.end_date, TRUE) AND COALESCE(b.start_date < b.end_date, TRUE)
       AND a.start_date < COALESCE(b.end_date, DATE '9999-12-31') AND b.start_date < COALESCE(a.end_date, DATE '9999-12-31')
  GROUP BY a.symbol, a.start_date, a.end_date""",
}


def _snapshot_files(s: Standins) -> DataFrame:
    """Snapshots as source text: mixed date formats, quoted tickers and removal suffixes."""
    day = F.col("change_date")
    text = (
        F.when(F.month(day) % 3 == 0, F.date_format(day, "MM/dd/yyyy"))
        .when(F.month(day) % 3 == 1, F.date_format(day, "MM-dd-yyyy"))
        .otherwise(F.date_format(day, "yyyy-MM-dd"))
    )
    name = F.when(F.col("symbol").endswith("3"), F.concat(F.lit(" '"), F.lower("symbol"), F.lit("-199702'"))).otherwise(F.col("symbol"))
    # A row lists the at most 100 suppliers that share all but the last two digits.
    block = F.expr("substring(symbol, 1, length(symbol) - 2)")
    lines = s.snapshots.groupBy("change_date", block.alias("block")).agg(F.array_join(F.collect_list(name), ",").alias("tickers"))
    return lines.select(text.alias("date"), "tickers")


def _parsed_snapshots(s: Standins) -> DataFrame:
    return snapshots_to_intervals(
        parse_snapshots(_snapshot_files(s)).select("change_date", F.explode("tickers").alias("symbol"))
    )


def _snapshot_versions(s: Standins) -> DataFrame:
    """Snapshot files, one for each hundred suppliers, with lists over several lines; read, checked and stamped by file."""
    path = f"{shared_folder(s.spark)}/pitlab/snapshots-{uuid.uuid4().hex}"
    block = F.expr("substring(symbol, 1, length(symbol) - 2)")
    lines = s.snapshots.groupBy(block.alias("symbol"), F.date_format("change_date", "yyyy-MM-dd").alias("date")).agg(
        F.concat(F.array_join(F.sort_array(F.collect_list("symbol")), ",\n"), F.lit(",")).alias("tickers")
    )
    write_files(lines.repartition("symbol").sortWithinPartitions("symbol", "date"), path)
    return read_memberships(s.spark, path).drop("source")


def _other_source(s: Standins) -> DataFrame:
    """A second opinion on membership: intervals that ended are listed 40 days longer."""
    return s.memberships.withColumn("end_date", F.date_add("end_date", 40))


def _early(s: Standins) -> DataFrame:
    """A biased selection: today's members on every past date."""
    return u.current_universe(s.memberships, s.rebalances).select("as_of", "symbol")


_LEAK = """
  SELECT r.as_of, c.symbol FROM rebalances r CROSS JOIN (SELECT DISTINCT symbol FROM memberships WHERE end_date IS NULL) c
  WHERE EXISTS (SELECT 1 FROM memberships m WHERE m.symbol = c.symbol AND m.end_date IS NULL AND m.start_date > r.as_of)
    AND NOT EXISTS (SELECT 1 FROM memberships m WHERE m.symbol = c.symbol AND m.start_date <= r.as_of AND (m.end_date IS NULL OR r.as_of < m.end_date))"""

_CHANGES = {
    "u2": "SELECT r.n, x.* FROM universe x JOIN rebalances r USING (as_of)",
    "changes": """
  SELECT r.as_of AS rebalance_date, COALESCE(a.symbol, b.symbol) AS symbol, a.symbol IS NOT NULL AS eligible, a.start_date AS membership_start, a.end_date AS membership_end,
         CASE WHEN a.symbol IS NULL THEN 'left_index' WHEN b.symbol IS NULL THEN 'joined' ELSE 'member' END
         || CASE WHEN a.symbol IS NOT NULL AND a.symbol LIKE '%7' THEN ';suspicious' ELSE '' END AS eligibility_reason
  FROM u2 a FULL OUTER JOIN u2 b ON b.symbol = a.symbol AND b.n = a.n - 1 JOIN rebalances r ON r.n = COALESCE(a.n, b.n + 1)""",
}


def _suspicious(s: Standins) -> DataFrame:
    return s.memberships.filter(F.col("symbol").endswith("7")).select("symbol").distinct()


def _report(s: Standins) -> DataFrame:
    return u.universe_report(s.memberships, ASOF)


def _source_precedence(s: Standins) -> DataFrame:
    settings = s.table("supplier").filter(F.col("s_acctbal") < 0).select(F.concat(F.lit(" "), F.lower(ticker("s_suppkey"))).alias("symbol"))
    return u.resolve_universe(None, settings, s.bars.select("symbol").distinct())


QUERIES: dict[str, Query] = {
    "membership_intervals": Query(
        lambda s: s.memberships, T("memberships", "SELECT symbol, start_date, end_date FROM memberships"), "W09 D3 D4 S12"
    ),
    "snapshot_files": Query(
        _parsed_snapshots, T("memberships", "SELECT symbol, start_date, end_date FROM memberships"), "S09 W09 P01"
    ),
    "snapshot_versions": Query(
        _snapshot_versions,
        T(
            "memberships snapshots",
            """SELECT m.symbol, m.start_date, m.end_date, v.source_version FROM memberships m JOIN (
                 SELECT block, sha256('"symbol","date","tickers"' || chr(10)
                          || string_agg('"' || block || '","' || change_date || '","' || tickers || ',"' || chr(10), '' ORDER BY change_date)) AS source_version
                 FROM (SELECT left(symbol, length(symbol) - 2) AS block, change_date, string_agg(symbol, ',' || chr(10) ORDER BY symbol) AS tickers
                       FROM snapshots GROUP BY ALL) l GROUP BY block) v ON v.block = left(m.symbol, length(m.symbol) - 2)""",
        ),
        "S09 S10 W09",
    ),
    "universe_as_of": Query(
        lambda s: u.universe_as_of(s.memberships, s.rebalances),
        T("universe", "SELECT as_of, symbol, start_date, end_date FROM universe"),
        "J01 P08 T03",
    ),
    "universe_daily_size": Query(
        lambda s: u.universe_as_of(s.memberships, s.calendar.select(F.col("session").alias("as_of"))).groupBy("as_of").agg(
            F.count(F.lit(1)).alias("members")
        ),
        T(
            "memberships calendar",
            """SELECT c.session AS as_of, COUNT(DISTINCT m.symbol) AS members FROM calendar c
               JOIN memberships m ON m.start_date <= c.session AND (m.end_date IS NULL OR c.session < m.end_date) GROUP BY c.session""",
        ),
        "J01",
    ),
    "current_universe": Query(
        lambda s: u.current_universe(s.memberships, s.rebalances),
        T(
            "memberships rebalances",
            "SELECT r.as_of, m.symbol, TRUE AS survivorship_biased FROM rebalances r CROSS JOIN (SELECT DISTINCT symbol FROM memberships WHERE end_date IS NULL) m",
        ),
        "J02",
    ),
    "membership_history": Query(
        lambda s: memberships_of(s.memberships),
        T("memberships", "SELECT symbol, start_date, end_date FROM memberships"),
        "S12",
    ),
    "available_symbols": Query(
        lambda s: u.available_symbols(s.table("part").select(F.concat(F.lit(" "), F.lower(ticker("p_partkey"))).alias("symbol")), s.bars.select("symbol")),
        T("bars", "SELECT printf('S%06d', p_partkey) AS symbol FROM part UNION SELECT symbol FROM bars"),
        "U05",
    ),
    "members_on_date": Query(
        lambda s: members_on(s.memberships, ASOF),
        T("memberships", "SELECT symbol, start_date, end_date FROM memberships WHERE start_date <= DATE '1999-06-15' AND (end_date IS NULL OR DATE '1999-06-15' < end_date)"),
        "S12 J01",
    ),
    "members_in_window": Query(
        lambda s: u.members_overlapping(s.memberships, date(1997, 3, 1), date(1997, 5, 31)),
        T("memberships", "SELECT DISTINCT symbol FROM memberships WHERE start_date <= DATE '1997-05-31' AND (end_date IS NULL OR DATE '1997-03-01' < end_date)"),
        "J03 P09",
    ),
    "missing_members": Query(
        lambda s: u.missing_members(
            u.universe_as_of(s.memberships, s.rebalances),
            misfiled(
                s.bars.join(s.securities.filter("status = 'DELISTED'").select(F.concat(F.lit("S"), F.substring("seed_key", 5, 6)).alias("symbol"), F.lit(True).alias("_gone")), "symbol", "left"),
                F.col("_gone").isNotNull(),
            ).drop("_gone"),
        ),
        T(
            "universe bars securities",
            """SELECT as_of, symbol FROM universe WHERE symbol NOT IN
               (SELECT symbol FROM bars WHERE symbol NOT IN (SELECT 'S' || substr(seed_key, 5, 6) FROM securities WHERE status = 'DELISTED'))""",
        ),
        "J05",
    ),
    "universe_changes": Query(
        lambda s: u.universe_changes(s.memberships, s.rebalances, _suspicious(s)),
        T("universe", "SELECT * FROM changes", _CHANGES),
        "W10 U02 S20",
    ),
    "universe_summary": Query(
        lambda s: u.universe_summary(s.memberships, s.rebalances, _suspicious(s)),
        T(
            "universe",
            """SELECT r.as_of AS rebalance_date, COUNT(*) FILTER (WHERE eligible) AS universe_size, COUNT(*) FILTER (WHERE eligibility_reason LIKE 'joined%') AS new_constituents,
                      COUNT(*) FILTER (WHERE eligibility_reason = 'left_index') AS removed_constituents,
                      COUNT(*) FILTER (WHERE eligibility_reason LIKE '%;suspicious') AS suspicious_constituents, CAST(0 AS BIGINT) AS invalid_constituents
               FROM rebalances r LEFT JOIN changes c ON c.rebalance_date = r.as_of GROUP BY r.as_of""",
            _CHANGES,
        ),
        "A20 S20",
    ),
    "universe_report": Query(
        _report,
        T(
            "memberships",
            """SELECT COUNT(*) FILTER (WHERE member) AS members, MIN(a) AS earliest_start, MAX(z) AS latest_start, MAX(e) AS latest_end, CAST(SUM(k) AS BIGINT) AS intervals,
                      CAST(SUM(k) AS BIGINT) AS changes, COUNT(*) FILTER (WHERE k > 1) AS multi_period_symbols, CAST(SUM(o) AS BIGINT) AS active_members, COUNT(*) FILTER (WHERE o = 0) AS historical_only
               FROM (SELECT symbol, BOOL_OR(start_date <= DATE '1999-06-15' AND (end_date IS NULL OR DATE '1999-06-15' < end_date)) AS member, COUNT(*) AS k,
                            COUNT(*) FILTER (WHERE end_date IS NULL) AS o, MIN(start_date) AS a, MAX(start_date) AS z, MAX(end_date) AS e FROM memberships GROUP BY symbol) q""",
        ),
        "A19",
    ),
    "encountered_symbols": Query(
        lambda s: u.encountered_symbols(s.memberships, s.rebalances), T("universe", "SELECT DISTINCT symbol FROM universe"), "A17"
    ),
    "appearances": Query(
        lambda s: u.appearances(s.memberships, s.rebalances),
        T("universe", "SELECT symbol, MIN(as_of) AS first_appearance, MAX(as_of) AS last_appearance, COUNT(*) AS appearances FROM universe GROUP BY symbol"),
        "W11",
    ),
    "membership_extents": Query(
        lambda s: u.membership_extents(s.memberships),
        T("memberships", "SELECT symbol, MIN(start_date) AS first_start, CASE WHEN COUNT(*) = COUNT(end_date) THEN MAX(end_date) END AS latest_end FROM memberships GROUP BY symbol"),
        "W14",
    ),
    "future_leakage": Query(
        lambda s: u.future_leakage(_early(s), s.memberships), T("memberships rebalances", _LEAK), "Q01"
    ),
    "interval_validation": Query(
        lambda s: u.validate_memberships(claims(s)), T("", "SELECT symbol, start_date, end_date, copies, overlap_count, impossible FROM checked", _CLAIMS), "W12 P10"
    ),
    "valid_intervals": Query(
        lambda s: overlap_counts(claims(s), ["symbol", "p_type"], "start_date", "end_date")
        .filter("overlap_count = 0 and not impossible")
        .groupBy("symbol", "p_type")
        .agg(F.count(F.lit(1)).alias("intervals"), F.sum("copies").alias("rows")),
        T(
            "",
            """SELECT symbol, p_type, COUNT(*) AS intervals, CAST(SUM(copies) AS BIGINT) AS rows FROM typed a WHERE COALESCE(start_date < end_date, TRUE) AND NOT EXISTS (
                 SELECT 1 FROM typed b WHERE a.symbol = b.symbol AND a.p_type = b.p_type AND (a.start_date <> b.start_date OR a.end_date IS DISTINCT FROM b.end_date)
                 AND COALESCE(b.start_date < b.end_date, TRUE) AND a.start_date < COALESCE(b.end_date, DATE '9999-12-31') AND b.start_date < COALESCE(a.end_date, DATE '9999-12-31'))
               GROUP BY symbol, p_type""",
            {"claims": _CLAIMS["claims"], "typed": "SELECT symbol, p_type, start_date, end_date, COUNT(*) AS copies FROM claims GROUP BY ALL"},
        ),
        "W12 Q08",
    ),
    "membership_cross_check": Query(
        lambda s: u.cross_check(
            u.universe_as_of(s.memberships, s.rebalances), u.universe_as_of(_other_source(s), s.rebalances)
        ),
        T(
            "memberships rebalances universe",
            """SELECT as_of, COUNT(l) AS left_count, COUNT(r) AS right_count, COUNT(*) FILTER (WHERE l IS NULL OR r IS NULL) AS disagreements,
                      COALESCE(array_to_string((array_agg(symbol ORDER BY symbol) FILTER (WHERE r IS NULL))[1:50], ','), '') AS only_left,
                      COALESCE(array_to_string((array_agg(symbol ORDER BY symbol) FILTER (WHERE l IS NULL))[1:50], ','), '') AS only_right
               FROM (SELECT COALESCE(a.as_of, b.as_of) AS as_of, COALESCE(a.symbol, b.symbol) AS symbol, a.symbol AS l, b.symbol AS r
                     FROM universe a FULL OUTER JOIN (SELECT DISTINCT r.as_of, m.symbol FROM rebalances r JOIN memberships m ON m.start_date <= r.as_of
                                                      AND (m.end_date IS NULL OR r.as_of < m.end_date + 40)) b ON a.as_of = b.as_of AND a.symbol = b.symbol) q
               GROUP BY as_of""",
        ),
        "J26 U02 U03",
    ),
    "universe_precedence": Query(
        _source_precedence, "SELECT DISTINCT printf('S%06d', s_suppkey) AS symbol FROM supplier WHERE s_acctbal < 0", "U05 S03"
    ),
}
