"""The stand-in tables as SQL common table expressions, written apart from the Spark code."""

from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "bars": (
        (),
        """
  SELECT printf('S%06d', l_suppkey) AS symbol, CAST(l_shipdate AS DATE) AS session,
         CAST(l_shipdate AS DATE) + INTERVAL '14 hours 30 minutes' AS ts,
         MAX(CASE WHEN a = 1 THEN px END) AS open, MAX(px) AS high, MIN(px) AS low,
         MAX(CASE WHEN z = 1 THEN px END) AS close,
         CASE WHEN SUM(q) % 29 <> 0 THEN MAX(CASE WHEN z = 1 THEN CAST(px * (1 - disc) AS DECIMAL(18,6)) END) END AS adjusted_close,
         CAST(SUM(q) AS BIGINT) AS volume
  FROM (SELECT l_suppkey, l_shipdate, CAST(l_extendedprice AS DECIMAL(18,2)) AS px, CAST(l_quantity AS BIGINT) AS q,
               CAST(l_discount AS DECIMAL(4,2)) AS disc,
               ROW_NUMBER() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount) AS a,
               ROW_NUMBER() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC, l_quantity DESC, l_discount DESC) AS z
        FROM lineitem) t
  GROUP BY l_suppkey, l_shipdate""",
    ),
    "raw_bars": (
        (),
        """
  SELECT *, CASE WHEN naive THEN 1 ELSE 0 END + CASE WHEN high < low THEN 1 ELSE 0 END + CASE WHEN high < open THEN 1 ELSE 0 END
            + CASE WHEN high < close THEN 1 ELSE 0 END + CASE WHEN low > open THEN 1 ELSE 0 END + CASE WHEN low > close THEN 1 ELSE 0 END
            + CASE WHEN volume < 0 THEN 1 ELSE 0 END AS n_issues
  FROM (SELECT printf('S%06d', l_suppkey) AS symbol, CAST(l_shipdate AS DATE) AS session,
         CAST(l_shipdate AS DATE) + INTERVAL '14 hours 30 minutes' AS ts, l_linenumber = 7 AS naive, px AS open, px AS close,
         CASE WHEN l_tax = 0.08 THEN px * CAST(0.98 AS DECIMAL(3,2)) ELSE px * CAST(1.02 AS DECIMAL(3,2)) END AS high,
         CASE WHEN l_tax = 0.08 THEN px * CAST(1.02 AS DECIMAL(3,2)) ELSE px * CAST(0.98 AS DECIMAL(3,2)) END AS low,
         CASE WHEN l_discount <> 0 THEN px * (1 - CAST(l_discount AS DECIMAL(4,2))) END AS adjusted_close,
         CAST(l_quantity AS BIGINT) * CASE WHEN l_discount = 0.1 AND l_tax = 0.05 THEN -1 ELSE 1 END AS volume,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(px * 100 AS BIGINT), CAST(l_quantity AS BIGINT)) AS source,
         l_orderkey AS row_number, l_returnflag AS feed
        FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) AS px FROM lineitem) l) r""",
    ),
    "calendar": (
        (),
        """
  SELECT session, ROW_NUMBER() OVER (ORDER BY session) AS idx, LAG(session) OVER (ORDER BY session) AS prev_session,
         LEAD(session) OVER (ORDER BY session) AS next_session
  FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS session FROM lineitem) s""",
    ),
    "rebalances": (
        ("calendar",),
        """
  SELECT session AS as_of, next_session AS execution_session, ROW_NUMBER() OVER (ORDER BY session) AS n
  FROM calendar WHERE prev_session IS NULL OR date_trunc('month', prev_session) <> date_trunc('month', session)""",
    ),
    "snapshots": (
        (),
        """
  SELECT CAST(date_trunc('month', l_shipdate) + INTERVAL '1' MONTH AS DATE) AS change_date, printf('S%06d', l_suppkey) AS symbol
  FROM lineitem GROUP BY 1, 2 HAVING SUM(CAST(l_quantity AS BIGINT)) >= 150""",
    ),
    "memberships": (
        ("snapshots",),
        """
  SELECT symbol, MIN(change_date) AS start_date, (SELECT MIN(d.change_date) FROM snapshots d WHERE d.change_date > MAX(g.change_date)) AS end_date
  FROM (SELECT s.symbol, s.change_date, SUM(fresh) OVER (PARTITION BY s.symbol ORDER BY s.change_date) AS island
        FROM (SELECT x.symbol, x.change_date,
                     CASE WHEN LAG(x.change_date) OVER (PARTITION BY x.symbol ORDER BY x.change_date) = p.before THEN 0 ELSE 1 END AS fresh
              FROM snapshots x JOIN (SELECT change_date, LAG(change_date) OVER (ORDER BY change_date) AS before
                                     FROM (SELECT DISTINCT change_date FROM snapshots) q) p ON p.change_date = x.change_date) s) g
  GROUP BY symbol, island""",
    ),
    "fund_trades": (
        (),
        """
  SELECT CAST(c_nationkey AS BIGINT) AS portfolio_id,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT), CAST(l_quantity AS BIGINT)) AS order_id,
         printf('S%06d', l_suppkey) AS position_key, CAST(l_shipdate AS DATE) AS session, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
         CAST(l_linenumber AS BIGINT) AS quantity, CASE WHEN l_tax > 0 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS market_price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    ),
    "fund_fills": (
        ("fund_trades",),
        """
  SELECT *, quantity * px AS v, CAST(quantity * px * CAST(0.0005 AS DECIMAL(4,4)) AS DECIMAL(28,10)) AS fee
  FROM (SELECT *, CAST(market_price * CASE WHEN side = 'BUY' THEN CAST(1.001 AS DECIMAL(4,3)) ELSE CAST(0.999 AS DECIMAL(4,3)) END AS DECIMAL(18,5)) AS px
        FROM (SELECT * FROM fund_trades WHERE market_price IS NOT NULL
              UNION ALL
              SELECT portfolio_id, '-open', position_key, MIN(session), 'BUY', CAST(SUM(quantity) FILTER (WHERE side = 'SELL') AS BIGINT), MIN(market_price) FILTER (WHERE side = 'SELL')
              FROM fund_trades WHERE market_price IS NOT NULL GROUP BY portfolio_id, position_key HAVING SUM(quantity) FILTER (WHERE side = 'SELL') > 0) t) p""",
    ),
    "securities": (
        (),
        """
  SELECT 'sec-' || printf('%06d', s_suppkey) AS seed_key, s_name AS display_name,
         CASE WHEN s_suppkey % 10 = 2 THEN 'DELISTED' ELSE 'ACTIVE' END AS status FROM supplier WHERE s_suppkey % 10 <= 8
  UNION ALL
  SELECT 'sec-' || printf('%06d', s_suppkey) || '-old', s_name, CASE WHEN s_suppkey % 10 = 0 THEN 'DELISTED' ELSE 'ACTIVE' END
  FROM supplier WHERE s_suppkey % 10 IN (0, 4)""",
    ),
    "tickers": (
        (),
        """
  SELECT 'sec-' || printf('%06d', s_suppkey) || r.old AS seed_key, r.scheme, printf('S%06d', s_suppkey) || r.sfx AS ticker,
         CAST(r.valid_from AS DATE) AS valid_from, CAST(r.valid_to AS DATE) AS valid_to, CAST(r.ord AS BIGINT) AS ord
  FROM supplier JOIN (VALUES
    (0, 1, '-old', 'listing', '', '1995-01-01', '1997-01-01'), (0, 2, '', 'listing', '', '1997-07-01', NULL),
    (0, 3, '', 'vendor', '', '1997-07-01', NULL), (1, 1, '', 'listing', '', '1995-01-01', '1999-01-01'),
    (1, 2, '', 'listing', 'X', '1999-01-01', NULL), (1, 3, '', 'vendor', 'X', '1995-01-01', NULL),
    (2, 1, '', 'listing', '', '1995-01-01', '2001-10-01'), (2, 2, '', 'vendor', '', '1995-01-01', '2001-10-01'),
    (3, 1, '', 'listing', '', '1996-01-01', NULL), (3, 2, '', 'vendor', '', '1996-01-01', NULL),
    (4, 1, '-old', 'listing', '', '1995-01-01', '1999-01-01'), (4, 2, '', 'listing', '', '1998-01-01', NULL),
    (4, 3, '-old', 'vendor', '', '1995-01-01', '1998-01-01'), (4, 4, '', 'vendor', '', '1998-01-01', NULL),
    (5, 1, '', 'listing', '', '1994-01-01', NULL), (5, 2, '', 'vendor', '', '1994-01-01', NULL),
    (6, 1, '', 'listing', '', '1994-01-01', NULL), (6, 2, '', 'vendor', '', '1994-01-01', NULL),
    (7, 1, '', 'listing', '', '1994-01-01', NULL), (7, 2, '', 'vendor', '', '1994-01-01', NULL),
    (8, 1, '', 'listing', '', '1994-01-01', NULL), (8, 2, '', 'vendor', '', '1994-01-01', NULL)
  ) AS r(digit, ord, old, scheme, sfx, valid_from, valid_to) ON s_suppkey % 10 = r.digit""",
    ),
    "trades": (
        (),
        """
  SELECT o_custkey AS portfolio_id,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT), CAST(l_quantity AS BIGINT)) AS order_id,
         printf('S%06d', l_suppkey % 10) AS position_key, CAST(l_shipdate AS DATE) AS session,
         CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, CAST(l_linenumber AS BIGINT) AS quantity,
         CASE WHEN l_tax > 0 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS market_price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    ),
    "accounts": ((), "SELECT c_custkey AS portfolio_id, CAST(c_acctbal AS DECIMAL(18,2)) * 100 AS cash FROM customer"),
    "holdings": (
        ("trades",),
        """
  SELECT portfolio_id, 'security:' || position_key AS position_key, position_key AS symbol, SUM(quantity) AS quantity,
         COALESCE(MAX(market_price), 0) AS market_price, SUM(quantity) % 11 <> 0 AS valued
  FROM trades WHERE side = 'SELL' GROUP BY portfolio_id, position_key""",
    ),
    "wanted": (
        ("trades",),
        """
  SELECT DISTINCT portfolio_id, position_key AS symbol, 'security:' || position_key AS position_key
  FROM trades WHERE side = 'BUY' AND market_price IS NOT NULL""",
    ),
    "vendor": (
        (),
        """
  SELECT printf('S%06d', s_suppkey) || r.sfx AS vendor_symbol, r.letter || printf('%06d', s_suppkey) AS asset_id, upper(s_name) AS security_name,
         CAST(r.first_quoted AS DATE) AS first_quoted, CAST(r.last_quoted AS DATE) AS last_quoted
  FROM supplier JOIN (
     SELECT d AS digit, '' AS sfx, 'A' AS letter, '1996-06-01' AS first_quoted, NULL AS last_quoted FROM range(10) t(d) WHERE d <> 2
     UNION ALL VALUES (0, '-199701', 'D', '1994-01-01', '1997-01-01'), (2, '-200110', 'D', '1994-01-01', '2001-10-01'),
                      (2, '-199901', 'E', '1994-01-01', '1999-01-01'), (1, 'X', 'A', '1995-01-01', NULL)
  ) AS r ON s_suppkey % 10 = r.digit""",
    ),
    "universe": (
        ("memberships", "rebalances"),
        """
  SELECT r.as_of, m.symbol, MIN(m.start_date) AS start_date, MIN(m.end_date) AS end_date
  FROM rebalances r JOIN memberships m ON m.start_date <= r.as_of AND (m.end_date IS NULL OR r.as_of < m.end_date)
  GROUP BY r.as_of, m.symbol""",
    ),
    "price_windows": (
        ("bars",),
        """
  SELECT symbol, MIN(session) AS first_date, MAX(session) AS last_date, arg_min(close, session) AS first_close,
         arg_max(close, session) AS last_close, COUNT(*) AS bars
  FROM bars GROUP BY symbol""",
    ),
}


def with_tables(needed: str, body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` under the named stand-ins and all they build on, then ``extra`` CTEs in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][0]:
            visit(dep)
        order.append(name)

    for name in needed.split():
        visit(name)
    parts = [f"{name} AS MATERIALIZED ({CTES[name][1]})" for name in order]
    parts += [f"{name} AS ({text})" for name, text in (extra or {}).items()]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body
