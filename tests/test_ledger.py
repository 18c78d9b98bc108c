from __future__ import annotations

import math
import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from conftest import ramp
from pyspark.sql import functions as F

from pitlab.operators.calendars import trading_calendar
from pitlab.operators.ranking import full_rank, number_rows
from pitlab.params import LedgerParams, ParameterError
from pitlab.plans import ledger as l
from pitlab.plans import performance as perf
from pitlab.plans import portfolio as p
from pitlab.sources import sinks, tables

ORDERS = "portfolio_id long, order_id string, position_key string, session date, side string, quantity long, market_price decimal(18,6)"
DAY = date(2020, 1, 1)


def orders(spark, rows):
    return spark.createDataFrame(
        [(pf, f"{i:05d}", key, DAY + timedelta(days=day), side, q, None if px is None else Decimal(str(px))) for i, (pf, key, day, side, q, px) in enumerate(rows)], ORDERS
    )


def test_hand_ledger(spark):
    params = LedgerParams(initial_cash=Decimal(1000), commission_rate=Decimal("0.01"), slippage_bps=Decimal(100))
    rows = [
        (1, "A", 0, "BUY", 5, 100), (1, "A", 1, "BUY", 3, 200), (1, "A", 1, "SELL", 6, 100), (1, "A", 2, "SELL", 2, 300),
        (1, "B", 2, "BUY", 1, None), (1, "A", 3, "BUY", 1, 50), (1, "A", 4, "SELL", 4, 10),
    ]
    got = l.replay_ledger(orders(spark, rows), params).orderBy("session", "order_id").collect()
    assert [(r["status"], r["reject_reason"], r["position_quantity"], r["outcome"]) for r in got] == [
        ("FILLED", None, 5, None),
        ("REJECTED", "insufficient cash", 5, None),
        ("REJECTED", "insufficient position", 5, None),
        ("FILLED", None, 3, "WIN"),
        ("REJECTED", "no price", 0, None),
        ("FILLED", None, 4, None),
        ("FILLED", None, 0, "LOSS"),
    ]
    assert got[0]["cash"] == Decimal("1000") - Decimal("505") * Decimal("1.01")
    assert got[0]["commission"] == Decimal("5.05") and got[0]["slippage"] == Decimal("5")
    assert got[5]["average_price"] == (3 * Decimal("101") + Decimal("50.5")) / 4
    assert got[3]["portfolio_value"] == got[3]["cash"] + 3 * Decimal("297")
    stats = l.trade_statistics(l.replay_ledger(orders(spark, rows), params)).first()
    assert (stats["fills"], stats["rejected"], stats["winning_trades"], stats["losing_trades"]) == (4, 3, 1, 1)


def random_tape(n, seed=3):
    rng = random.Random(seed)
    # Portfolio 1 holds most of the tape.
    return [
        (1 if rng.random() < 0.7 else rng.randrange(2, 9), rng.choice("ABC"), i // 7, rng.choice(["BUY", "BUY", "SELL"]), rng.randrange(1, 9), rng.choice([None, 10, 11.5, 37.25]))
        for i in range(n)
    ]


def brute(rows, params):
    cash, held, out = {}, {}, []
    for i, (pf, key, _, side, q, px) in enumerate(rows):
        c, h = cash.setdefault(pf, params.initial_cash), held.setdefault(pf, {})
        ok = px is not None
        if ok:
            px = Decimal(str(px)) * (1 + (1 if side == "BUY" else -1) * params.slippage_bps / 10000)
            fee = q * px * params.commission_rate
            if side == "BUY":
                ok = q * px + fee <= c
            else:
                ok = q <= h.get(key, 0)
        if ok:
            cash[pf] += -(q * px) - fee if side == "BUY" else q * px - fee
            h[key] = h.get(key, 0) + (q if side == "BUY" else -q)
        out.append((f"{i:05d}", "FILLED" if ok else "REJECTED", cash[pf], h.get(key, 0)))
    return out


@pytest.mark.parametrize("chunk", [1_000_000, 40])
def test_ledger_equals_a_plain_loop_even_in_rounds(spark, chunk):
    params = LedgerParams(initial_cash=Decimal(500), commission_rate=Decimal("0.001"), slippage_bps=Decimal(10))
    rows = random_tape(300)
    got = l.replay_ledger(orders(spark, rows), params, chunk_rows=chunk).orderBy("order_id").collect()
    assert [(r["order_id"], r["status"], r["cash"], r["position_quantity"]) for r in got] == brute(rows, params)


def test_rounds_agree_on_average_cost(spark):
    params = LedgerParams(initial_cash=Decimal(5000))
    tape = orders(spark, random_tape(200, seed=5))
    cols = ("order_id", "average_price", "portfolio_value", "outcome")
    one, many = (sorted(map(tuple, l.replay_ledger(tape, params, chunk_rows=c).select(*cols).collect())) for c in (10**6, 17))
    assert one == many


def positions(spark, rows):
    return spark.createDataFrame(
        [(1, k, k, Decimal(q), Decimal(str(a)), Decimal(str(m)), Decimal(str(c))) for k, q, a, m, c in rows],
        "portfolio_id long, position_key string, symbol string, quantity decimal(28,10), average_price decimal(28,10), market_price decimal(28,10), cash decimal(28,10)",
    )


def actions(spark, rows):
    dec = lambda x: None if x is None else Decimal(str(x))
    return spark.createDataFrame(
        [(k, DAY + timedelta(days=d), 1, kind, dec(f), dec(a), t, dec(px)) for k, d, kind, f, a, t, px in rows],
        "position_key string, effective_date date, seq long, action_type string, factor decimal(18,6), amount decimal(18,6), ticker string, terminal_price decimal(18,6)",
    )


def test_corporate_actions(spark):
    rows = [
        ("A", 0, "SPLIT", 3, None, None, None), ("A", 1, "CASH_DIVIDEND", None, "0.5", None, None), ("A", 2, "RENAME", None, None, "A2", None),
        ("A", 3, "REVERSE_SPLIT", "0.5", None, None, None), ("A", 4, "SHARE_CONVERSION", None, None, None, None), ("A", 5, "DELISTING", None, None, None, 7),
        ("B", 0, "CASH_ACQUISITION", None, None, None, None), ("B", 1, "CASH_ACQUISITION", None, 12, None, None),
    ]
    held = positions(spark, [("A", 3, 30, 60, 100), ("B", 2, 5, 6, 0)])
    got = {(r["position_key"], r["effective_date"].day): r for r in l.apply_actions(held, actions(spark, rows)).collect()}
    assert (got[("A", 1)]["quantity"], got[("A", 1)]["average_price"], got[("A", 1)]["market_price"]) == (9, 10, 20)
    assert got[("A", 2)]["cash"] == Decimal("104.5") and got[("A", 3)]["symbol"] == "A2"
    assert got[("A", 4)]["quantity"] == Decimal("4.5")
    assert got[("A", 5)]["application"] == got[("B", 1)]["application"] == "UNRESOLVED"
    assert (got[("A", 6)]["quantity"], got[("A", 6)]["cash"]) == (0, Decimal("136"))
    assert (got[("B", 2)]["quantity"], got[("B", 2)]["cash"]) == (0, 24)
    lieu = l.apply_actions(held, actions(spark, [("A", 0, "REVERSE_SPLIT", "0.5", None, None, None)]), cash_in_lieu=True).first()
    assert (lieu["quantity"], lieu["cash"]) == (1, 100 + Decimal("0.5") * 120)


@pytest.mark.parametrize("row", [("A", 0, "SPLIT", None, None, None, None), ("A", 0, "CASH_DIVIDEND", None, None, None, None), ("A", 0, "DELISTING", None, None, None, 0), ("A", 0, "MOON", None, None, None, None)])
def test_actions_without_terms_fail(spark, row):
    with pytest.raises(Exception, match="requires|unsupported"):
        l.apply_actions(positions(spark, [("A", 3, 30, 60, 100)]), actions(spark, [row])).collect()


def test_marks_hold_inside_a_series_and_stop_after_it(spark, make_bars):
    bars = make_bars({"A": [(0, 10, 1, 1), (3, 12, 1, 1)], "Z": ramp(6)})
    params = LedgerParams(initial_cash=Decimal(100))
    book = l.replay_ledger(orders(spark, [(1, "A", 0, "BUY", 2, 10)]), params)
    cal = trading_calendar(bars)
    marked = l.mark_positions(l.position_history(book), bars, cal)
    got = {r["session"].day: (r["mark"] and float(r["mark"]), r["valued"], r["held_price"]) for r in marked.collect()}
    assert got == {1: (10, True, False), 2: (10, True, True), 3: (10, True, True), 4: (12, True, False), 5: (None, False, False), 6: (None, False, False)}
    equity = [float(r["equity"]) for r in l.nav(marked, l.cash_history(book), cal).orderBy("session").collect()]
    assert equity == [100, 100, 100, 104, 80, 80]


def fills_of(spark, rows, params):
    priced = l.price_fills(orders(spark, rows), params)
    return priced.withColumns({c: F.col(c).cast("decimal(28,10)") for c in ("fill_price", "commission", "slippage")})


def covered_tape(n, seed):
    """Trades with a price whose sales never go beyond the holding."""
    drawn, held, rows = random.Random(seed), {}, []
    for i in range(n):
        pf, key = (1 if drawn.random() < 0.6 else drawn.randrange(2, 6)), drawn.choice("AABCZ")
        have = held.get((pf, key), 0)
        sell = have and drawn.random() < 0.5
        q = drawn.choice([have, drawn.randint(1, have)]) if sell else drawn.randrange(1, 9)
        held[pf, key] = have + (-q if sell else q)
        rows.append((pf, key, i // 9, "SELL" if sell else "BUY", q, drawn.choice(["10", "11.5", "37.25", "0.75"])))
    return rows


@pytest.mark.parametrize("parts", ["1", "6"])
def test_average_cost_of_fills_equals_the_replay(spark, parts):
    params = LedgerParams(initial_cash=Decimal(10**9), commission_rate=Decimal("0.001"), slippage_bps=Decimal(10))
    rows = covered_tape(260, 8)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r["order_id"]: r for r in l.fill_outcomes(fills_of(spark, rows, params)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = l.replay_ledger(orders(spark, rows), params).collect()
    assert {r["status"] for r in want} == {"FILLED"} and len(got) == len(want)
    for r in want:
        mine = got[r["order_id"]]
        assert (mine["position_quantity"], mine["outcome"]) == (r["position_quantity"], r["outcome"])
        assert abs(mine["average_price"] - r["average_price"]) < Decimal("0.00000001")
    stats = l.trade_statistics(l.fill_outcomes(fills_of(spark, rows, params))).drop("total_commission", "total_slippage")
    assert sorted(map(tuple, stats.collect())) == sorted(map(tuple, l.trade_statistics(l.replay_ledger(orders(spark, rows), params)).drop("total_commission", "total_slippage").collect()))


def test_equity_by_changes_equals_positions_on_every_session(spark, make_bars):
    params = LedgerParams(initial_cash=Decimal(10**6))
    drawn = random.Random(2)
    series = {k: [(d, drawn.randint(5, 90), 1, 1) for d in range(a, z) if drawn.random() < 0.4] for k, a, z in (("A", 0, 40), ("B", 3, 12), ("C", 20, 30), ("Q", 0, 40))}
    series["Q"] = [(d, 1, 1, 1) for d in range(40)]
    bars = make_bars(series)
    cal = trading_calendar(bars)
    rows = covered_tape(200, 5)
    fills = fills_of(spark, rows, params)
    book = l.replay_ledger(orders(spark, rows), params)
    marked = l.mark_positions(l.position_history(book), bars, cal)
    want = {(r["portfolio_id"], r["session"]): (r["cash"], r["equity"], r["unvalued_positions"]) for r in l.nav(marked, l.cash_history(book), cal).collect()}
    changes = l.position_changes(fills, bars, cal)
    accounts = spark.createDataFrame([(k, params.initial_cash) for k in range(1, 6)], "portfolio_id long, cash decimal(28,10)")
    got = {(r["portfolio_id"], r["session"]): (r["cash"], r["equity"], r["unvalued_positions"]) for r in l.nav_of_fills(fills, changes, accounts, cal).collect()}
    assert got == want and any(v[2] for v in want.values())
    days = marked.groupBy("symbol").agg(F.count(F.lit(1)).alias("d"), F.count_if("valued").alias("v"), F.count_if("held_price").alias("h"))
    assert sorted(map(tuple, l.position_days(changes, cal).collect())) == sorted(map(tuple, days.collect()))


def test_actions_compose_to_what_each_one_does(spark):
    drawn = random.Random(6)
    kinds = ["SPLIT", "CASH_DIVIDEND", "RENAME", "REVERSE_SPLIT", "SHARE_CONVERSION", "CASH_ACQUISITION", "NO_ACTION", "DELISTING"]
    rows = []
    for key in "ABCDE":
        for day in range(25):
            kind = drawn.choices(kinds, [6, 6, 3, 6, 1, 2, 1, 0.4])[0]
            rows.append((key, day, kind, drawn.choice(["2", "0.5", "1.5", "0.333333"]), drawn.choice(["0.25", "1.1"]) if kind != "CASH_ACQUISITION" or drawn.random() < 0.3 else None, drawn.choice([None, "", f"{key}{day}"]), "3.5"))
    held = [(k, 7 + i, 30, 60, 100) for i, k in enumerate("ABCDE")]
    want = {}
    for lieu in (False, True):
        for k, q, a, m, c in held:
            q, a, m, c, name = Decimal(q), Decimal(a), Decimal(m), Decimal(c), k
            for key, day, kind, f, d, t, px in rows:
                if key != k:
                    continue
                if kind in ("SPLIT", "REVERSE_SPLIT"):
                    q, a, m = q * Decimal(f), a / Decimal(f), m / Decimal(f)
                    if lieu:
                        c, q = c + (q - int(q)) * m, Decimal(int(q))
                elif kind == "CASH_DIVIDEND":
                    c += q * Decimal(d)
                elif kind == "RENAME":
                    name = t or name
                elif kind == "DELISTING" or (kind == "CASH_ACQUISITION" and d is not None):
                    m = Decimal(px if kind == "DELISTING" else d)
                    c, q = c + q * m, Decimal(0)
                want[lieu, k, day] = (name, q, a, m, c)
        found = l.apply_actions(positions(spark, held), actions(spark, rows), cash_in_lieu=lieu).collect()
        assert len(found) == len(rows)
        for r in found:
            name, *amounts = want[lieu, r["position_key"], (r["effective_date"] - DAY).days]
            assert r["symbol"] == name
            for column, amount in zip(("quantity", "average_price", "market_price", "cash"), amounts):
                assert abs(r[column] - amount) <= Decimal("0.0000001") * max(1, abs(amount)), (r, column, amount)


def test_known_curve(spark):
    nav = spark.createDataFrame([(1, DAY + timedelta(days=i), Decimal(e), Decimal(0)) for i, e in enumerate([110, 105, 120])], "portfolio_id long, session date, equity decimal(18,2), cash decimal(18,2)")
    curve = perf.equity_curve(nav, 100)
    rows = curve.orderBy("session").collect()
    assert [r["returns"] for r in rows] == pytest.approx([0, 105 / 110 - 1, 120 / 105 - 1])
    assert [r["drawdown"] for r in rows] == pytest.approx([0, 105 / 110 - 1, 0])
    m = perf.performance_metrics(curve, 100, start=DAY, end=DAY + timedelta(days=365)).first()
    a, b = 105 / 110 - 1, 120 / 105 - 1
    sd = abs(a - b) / 2**0.5
    assert m["total_return"] == pytest.approx(0.2) and m["annualized_return"] == pytest.approx(1.2 ** (365.25 / 365) - 1)
    assert m["volatility"] == pytest.approx(sd * 252**0.5) and m["sharpe_ratio"] == pytest.approx((a + b) / 2 / sd * 252**0.5)
    below = perf.equity_curve(nav, 200).orderBy("session").first()
    assert below["drawdown"] == pytest.approx(-0.45)
    flat = perf.performance_metrics(perf.equity_curve(nav.limit(1), 100), 100).first()
    assert (flat["volatility"], flat["sharpe_ratio"], flat["annualized_return"]) == (0, 0, 0)


def test_orders_from_targets(spark):
    hold = spark.createDataFrame(
        [(1, "k:A", "A", 10, Decimal(10), True), (1, "k:B", "B", 4, Decimal(25), True), (1, "k:GONE", "GONE", 9, Decimal(1), False)],
        "portfolio_id long, position_key string, symbol string, quantity long, market_price decimal(18,6), valued boolean",
    )
    goal = spark.createDataFrame([(1, "k:A", "A2", Decimal("0.5")), (1, "k:C", "C", Decimal("0.5"))], "portfolio_id long, position_key string, symbol string, weight decimal(19,18)")
    prices = spark.createDataFrame([("A2", Decimal(10)), ("B", Decimal(25)), ("C", Decimal(30)), ("A", Decimal(1))], "symbol string, price decimal(18,6)")
    cash = spark.createDataFrame([(1, Decimal(100))], "portfolio_id long, cash decimal(18,6)")
    params = LedgerParams(min_trade_value=Decimal(20))
    got = {r["position_key"]: (r["symbol"], r["side"], r["quantity"]) for r in p.order_deltas(hold, goal, prices, cash, params).collect()}
    # Equity is 300: the unvalued holding counts for nothing and has no price to trade at.
    assert got == {"k:A": ("A2", "BUY", 5), "k:B": ("B", "SELL", 4), "k:C": ("C", "BUY", 5)}
    assert [r[0] for r in p.missing_prices(hold, goal, prices).collect()] == ["GONE"]


def test_buys_stop_where_cash_does(spark):
    cols = "portfolio_id long, position_key string, symbol string, side string, quantity long, price decimal(18,6), fill_price decimal(24,10), target_shares long, held long"
    mk = lambda pf, key, side, q, px: (pf, key, key, side, q, Decimal(px), Decimal(px), 0, 0)
    deltas = spark.createDataFrame([mk(1, "a", "BUY", 5, 30), mk(1, "b", "BUY", 9, 40), mk(1, "c", "BUY", 2, 10), mk(1, "s", "SELL", 1, 50), mk(2, "a", "BUY", 5, 30), mk(2, "b", "BUY", 1, 5)], cols)
    cash = spark.createDataFrame([(1, Decimal(200)), (2, Decimal(155))], "portfolio_id long, cash decimal(18,6)")
    got = {(r["portfolio_id"], r["position_key"]): r["quantity"] for r in p.affordable_orders(deltas, cash, LedgerParams(min_trade_value=Decimal(10))).collect()}
    assert got == {(1, "s"): 1, (1, "a"): 5, (1, "b"): 2, (1, "c"): 2, (2, "a"): 5}
    named = p.sequence_orders(deltas.filter("portfolio_id = 1"), F.lit("2020-05-01").cast("date")).orderBy("sequence").collect()
    assert [(r["position_key"], r["client_order_id"]) for r in named] == [("s", "2020-05-01-0001"), ("a", "2020-05-01-0002"), ("b", "2020-05-01-0003"), ("c", "2020-05-01-0004")]


@pytest.mark.parametrize("seed", [1, 2])
def test_affordable_buys_equal_a_plain_loop(spark, seed):
    drawn = random.Random(seed)
    cols = "portfolio_id long, position_key string, symbol string, side string, quantity long, price decimal(18,6), fill_price decimal(24,10), target_shares long, held long"
    params = LedgerParams(commission_rate=Decimal("0.01"), min_trade_value=Decimal(25))
    rows = []
    for pf in range(1, 8):
        for k in range(300 if pf == 1 else drawn.randint(1, 25)):
            px = Decimal(drawn.choice(["0.5", "3", "7.25", "40", "41.5", "300"]))
            rows.append((pf, f"k{k:03d}", f"k{k}", drawn.choice(["BUY"] * 5 + ["SELL"]), drawn.randint(1, 60), px, px, 0, 0))
    cash = {pf: Decimal(drawn.choice([0, 90, 1500, 4000, 60_000, 10**7])) for pf in range(1, 8)} | {1: Decimal(50_000)}
    want = {}
    for pf in cash:
        mine = sorted((r for r in rows if r[0] == pf), key=lambda r: (r[3] != "SELL", r[1]))
        money = cash[pf]
        for _, key, _, side, q, px, *_ in mine:
            if side == "SELL":
                money += q * px * (1 - params.commission_rate)
            else:
                q = min(q, int(money / (px * (1 + params.commission_rate))) if money > 0 else 0)
                if q <= 0 or q * px < params.min_trade_value:
                    continue
                money -= q * px * (1 + params.commission_rate)
            want[pf, key, side] = q
    accounts = spark.createDataFrame(list(cash.items()), "portfolio_id long, cash decimal(18,6)")
    made = p.affordable_orders(spark.createDataFrame(rows, cols), accounts, params)
    assert {(r["portfolio_id"], r["position_key"], r["side"]): r["quantity"] for r in made.collect()} == want
    assert made._jdf.queryExecution().executedPlan().toString().count("budget-round") <= 2 * 10


@pytest.mark.parametrize(("one_in", "steps"), [(4096, 10), (8, 6), (1, 3), (3, 0)])
def test_numbers_equal_a_full_sort(spark, one_in, steps):
    rng = random.Random(1)
    keys = ["hot"] * 8 + ["x", None]
    rows = [(rng.choice(keys), f"s{i:04d}", rng.choice([0.1, 0.1, None, float("nan"), -0.0, rng.uniform(-3, 3)])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, symbol string, v double")
    got = {(r["k"], r["symbol"]): r["rank"] for r in full_rank(df, ["k"], "v", "symbol", drawn_one_in=one_in, steps=steps).collect()}
    for key in {r[0] for r in rows}:
        order = sorted((r for r in rows if r[0] == key), key=lambda r: ((2, 0) if r[2] is None else (0, 0) if math.isnan(r[2]) else (1, -r[2]), r[1]))
        assert [got[(key, r[1])] for r in order] == list(range(1, len(order) + 1))
    numbered = number_rows(df, ["k"], [F.col("symbol")], "n", one_in, steps)
    n = numbered.filter("k = 'hot'").orderBy("symbol").collect()
    assert [r["n"] for r in n] == list(range(1, len(n) + 1)) and numbered.columns == ["k", "symbol", "v", "n"]
    assert full_rank(df.filter("false"), ["k"], "v", "symbol").count() == 0


def test_whole_numbers_rank_downward(spark):
    low, high = -(2**63), 2**63 - 1
    df = spark.createDataFrame([(v, str(v)) for v in (low, -1, 0, 1, high)] + [(None, "z")], "v long, t string").withColumn("d", F.col("v").cast("decimal(20,0)"))
    for value in ("v", "d"):
        assert [r["v"] for r in full_rank(df, [], value, "t", drawn_one_in=1, steps=2).orderBy("rank").collect()] == [high, 1, 0, -1, low, None]


def test_a_hot_group_is_numbered_by_many_tasks_in_one_lazy_plan(spark):
    df = spark.range(20_000).select(F.when(F.col("id") >= 0, "hot").alias("k"), (F.col("id") % 7 * 1.0).alias("v"), F.col("id").cast("string").alias("t"))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    ranked = full_rank(df, ["k"], "v", "t", drawn_one_in=64)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) == jobs
    assert ranked.agg(F.sum("rank"), F.max("rank"), F.countDistinct("rank")).first()[:] == (20_000 * 20_001 // 2, 20_000, 20_000)
    ranked.collect()
    final = ranked._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "rangepartitioning" not in final and "ReusedExchange" in final  # counts and rows share a shuffle
    mapped = ranked.select("k", "v", "t", F.create_map("t", "v").alias("m"))
    assert full_rank(mapped, ["k"], "v", "t", drawn_one_in=64).filter("map_contains_key(m, t)").agg(F.countDistinct("rank")).first()[0] == 20_000


def test_parameters():
    for bad in ({"commission_rate": Decimal(-1)}, {"initial_cash": Decimal(0)}, {"frequency": "WEEKLY"}):
        with pytest.raises(ParameterError):
            LedgerParams(**bad)


def test_order_log(spark):
    log = spark.createDataFrame([("a", 1, "CREATED"), ("a", 2, "SUBMITTED"), ("b", 3, "FILLED"), ("c", 4, "ACKNOWLEDGED")], "client_order_id string, seq long, status string")
    assert {r[0] for r in tables.open_orders(log).select("client_order_id").collect()} == {"a", "c"}
    asked = spark.createDataFrame([("a",), ("zz",)], "client_order_id string")
    assert {r["client_order_id"]: r["status"] for r in tables.status_of(asked, log).collect()} == {"a": "SUBMITTED", "zz": "FAILED"}
    every = spark.createDataFrame([(x,) for x in "abc"], "client_order_id string")
    assert [tuple(r) for r in tables.cancel(log, every).collect()] == [("a", 3, "CANCELLED")]
    with pytest.raises(LookupError):
        tables.require_order(log, "zz")


def test_exports(spark, tmp_path):
    fills = spark.sql("select timestamp'2020-01-02 14:30:00' as timestamp, 'A' as symbol, 5L as quantity, 10.5BD as market_price, 10.6BD as price, 0.1BD as commission, 0.5BD as slippage, 'o1' as order_id, cast(null as decimal(9,2)) as portfolio_value, 1BD as cash, 5L as position_quantity, cast(null as string) as security_id, 'l' as listing_id, 'k' as position_key")
    book = spark.sql("select 'o1' as client_order_id, 'A' as symbol, 'BUY' as side, 5L as quantity, 'MARKET' as order_type, 'FILLED' as status, cast(null as decimal(9,2)) as limit_price, 's' as security_id, 'l' as listing_id, 'k' as position_key")
    equity = spark.sql("select date'2020-01-02' as session, 100BD as equity, 1BD as cash, 0.0D as returns, 0.0D as drawdown")
    row = sinks.fills_export(fills, book).first()
    assert len(row) == 16 and (row["side"], row["gross_value"], row["portfolio_value"], row["security_id"]) == ("BUY", "53.0", "", "")
    assert sinks.fills_export(fills, book.filter("false")).first()["side"] == ""
    sinks.write_backtest_export(fills, book, equity, str(tmp_path))
    assert len(spark.read.csv(str(tmp_path / "orders"), header=True).columns) == 10
    assert len(spark.read.csv(str(tmp_path / "equity"), header=True).columns) == 5


def replayed(spark, make_bars):
    drawn = random.Random(12)
    series = {k: [(d, drawn.randint(5, 90), 1, 1) for d in range(a, z) if drawn.random() < 0.4] for k, a, z in (("A", 0, 40), ("B", 3, 12), ("C", 20, 30), ("Q", 0, 40))}
    series["Q"] = [(d, 1, 1, 1) for d in range(40)]
    bars = make_bars(series)
    rows = covered_tape(200, 5) + [(6, "A", 3, "SELL", 1, "9"), (7, "A", 39, "BUY", 2, "9"), (7, "C", 2, "BUY", 1, None)]
    return l.replay_ledger(orders(spark, rows), LedgerParams(initial_cash=Decimal(900))), bars, trading_calendar(bars)


@pytest.mark.parametrize("factor", [1, 10**11])
def test_equity_of_positions_equals_positions_on_every_session(spark, make_bars, factor):
    book, bars, cal = replayed(spark, make_bars)
    held = l.position_history(book).withColumn("quantity", F.col("quantity") * factor)
    assert book.filter("status = 'REJECTED'").count() > 2
    cash = l.cash_history(book)
    want = {(r["portfolio_id"], r["session"]): (r["cash"], r["equity"]) for r in l.nav(l.mark_positions(held, bars, cal), cash, cal).collect()}
    made = l.equity_of_positions(held, cash, bars, cal)
    got = {(r["portfolio_id"], r["session"]): (r["cash"], r["equity"]) for r in made.collect()}
    assert got == want
    # The marks meet the spans after their only shuffle, and what comes of them is not shuffled.
    text = l.equity_of_positions(held, cash, bars, cal)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(portfolio_id") == 1 and "BroadcastHashJoin" in text


def test_marked_days_equal_positions_on_every_session(spark, make_bars):
    book, bars, cal = replayed(spark, make_bars)
    bars = bars.withColumn("close", F.when(F.col("volume") > 0, F.col("close")))
    marked = l.mark_positions(l.position_history(book), bars, cal)
    days = marked.groupBy("symbol").agg(F.count(F.lit(1)).alias("d"), F.count_if("valued").alias("v"), F.count_if("held_price").alias("h"))
    made = l.marked_days(l.position_history(book), bars, cal)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, days.collect())) and made.columns == ["symbol", "position_days", "valued", "held"]


def test_measures_replay_every_customers_orders(spark):
    from pitlab.registry import all_queries
    from pitlab.standins.frames import Standins

    small = Standins(spark, "/root/testdata/sf0.001")
    portfolios = small.orders.select("portfolio_id").distinct().count()
    for name in ("trade_statistics", "performance_metrics"):
        assert all_queries()[name].build(small).count() == portfolios, name


def test_an_order_without_a_quantity_is_refused(spark):
    rows = orders(spark, [(1, "A", 0, "BUY", 2, "10"), (1, "A", 1, "BUY", 5, "10"), (1, "A", 2, "SELL", 5, "10")])
    rows = rows.withColumn("quantity", F.when(F.col("quantity") < 5, F.col("quantity")))
    got = l.replay_ledger(rows, LedgerParams(initial_cash=Decimal(100))).orderBy("session").collect()
    assert [(r["status"], r["reject_reason"]) for r in got] == [("FILLED", None), ("REJECTED", "no quantity"), ("REJECTED", "no quantity")]
    assert [r["position_quantity"] for r in got] == [2, 2, 2]


def test_last_actions_equal_an_aggregation_of_each(spark):
    rows = [("A", 0, "SPLIT", "2", None, None, None), ("A", 1, "CASH_DIVIDEND", None, "1.5", None, None), ("A", 1, "SHARE_CONVERSION", None, None, None, None), ("A", 2, "RENAME", None, None, "B", None), ("Z", 0, "SPLIT", "3", None, None, None)]
    held = positions(spark, [("A", 7, 30, 60, 100), ("C", 1, 1, 1, 1)])
    acts = actions(spark, rows)
    last = F.struct("effective_date", "action_type")
    want = l.apply_actions(held, acts).groupBy("portfolio_id", "position_key").agg(
        F.count_if(F.col("application") == "APPLIED").alias("applied"), F.count_if(F.col("application") == "UNRESOLVED").alias("unresolved"),
        F.max_by(F.struct("symbol", "quantity", "average_price", "market_price", "cash"), last).alias("e"),
    ).select("portfolio_id", "position_key", "applied", "unresolved", "e.*")
    made = l.after_all_actions(held, acts, last)
    assert made.columns == want.columns and made.collect() == want.collect() and made.first()["applied"] == 3
    # Before the join there is one row per key.
    assert "Join" in made._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[0]
