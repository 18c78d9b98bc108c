"""Signals to targets to orders, for any number of portfolios and dates at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlab.functions.prices import commission, fill_price, shares
from pitlab.operators.ranking import number_rows
from pitlab.operators.scan import blocked_sum, in_blocks
from pitlab.params import LedgerParams
from pitlab.session import materialize

MONEY = T.DecimalType(18, 6)
WEIGHT = T.DecimalType(19, 18)
WEIGHT_TOLERANCE = 1e-7


def equal_weight_targets(signals: DataFrame, keys: tuple[str, ...] = ("as_of",)) -> DataFrame:
    """1/N for each signal of its group. A date without signals has no rows: all cash."""
    sizes = signals.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return signals.join(sizes, list(keys)).withColumn("weight", (F.lit(1) / F.col("_n")).cast(WEIGHT)).drop("_n")


def cash_weights(dates: DataFrame, targets: DataFrame) -> DataFrame:
    """Cash left per date, and whether weights and cash add up to one."""
    invested = targets.groupBy("as_of").agg(F.sum("weight").cast("double").alias("invested"))
    joined = dates.select("as_of").join(invested, "as_of", "left").fillna(0.0, ["invested"])
    held = F.when(F.col("invested") > 0, F.lit(0.0)).otherwise(F.lit(1.0))
    return joined.select(
        "as_of",
        "invested",
        held.alias("cash_weight"),
        (F.abs(F.col("invested") + held - 1) <= WEIGHT_TOLERANCE).alias("balanced"),
    )


def portfolio_equity(accounts: DataFrame, holdings: DataFrame) -> DataFrame:
    """(portfolio_id, cash, equity): cash plus quantity x mark of valued positions."""
    worth = F.when(F.col("valued"), F.col("quantity") * F.col("market_price")).otherwise(F.lit(0))
    value = holdings.groupBy("portfolio_id").agg(F.sum(worth).alias("_v"))
    return accounts.join(value, "portfolio_id", "left").select(
        "portfolio_id", "cash", (F.col("cash") + F.coalesce("_v", F.lit(0))).cast(MONEY).alias("equity")
    )


def booked(holdings: DataFrame, targets: DataFrame) -> DataFrame:
    """Holdings and targets side by side per position key.

    A holding without a target gets weight 0; where both exist the target's ticker wins.
    """
    worth = F.when(F.col("valued"), F.col("quantity") * F.col("market_price")).otherwise(F.lit(0))
    h = holdings.select(
        "portfolio_id", "position_key", F.col("symbol").alias("_hs"), F.col("quantity").alias("_q"), worth.alias("_v")
    )
    t = targets.select("portfolio_id", "position_key", F.col("symbol").alias("_ts"), F.col("weight").alias("_w"))
    return h.join(t, ["portfolio_id", "position_key"], "full_outer").select(
        "portfolio_id",
        "position_key",
        F.coalesce("_ts", "_hs").alias("symbol"),
        F.coalesce("_q", F.lit(0)).cast("long").alias("held"),
        F.coalesce("_v", F.lit(0)).cast(MONEY).alias("held_value"),
        F.coalesce("_w", F.lit(0)).cast(WEIGHT).alias("weight"),
    )


def order_deltas(
    holdings: DataFrame, targets: DataFrame, prices: DataFrame, accounts: DataFrame, params: LedgerParams
) -> DataFrame:
    """Wanted whole-share trades: floor(weight x equity / slipped price) less what is held.

    No or non-positive price, and differences below the minimum trade, are skipped; a sale
    never exceeds the holding. Divisions are exact integer divisions of decimals.
    """
    equity = portfolio_equity(accounts, holdings)
    rows = booked(holdings, targets).join(equity.select("portfolio_id", "equity"), "portfolio_id")
    rows = rows.join(prices.select("symbol", F.col("price").cast(MONEY).alias("price")), "symbol").filter("price > 0")
    rows = rows.withColumn("target_value", F.col("equity") * F.col("weight"))
    rows = rows.filter(F.abs(F.col("target_value") - F.col("held_value")) >= F.lit(params.min_trade_value))
    intent = F.when(F.col("target_value") >= F.col("held_value"), "BUY").otherwise("SELL")
    rows = rows.withColumn("_side", intent).withColumn(
        "fill_price", fill_price(F.col("_side"), F.col("price"), params.slippage_bps)
    )
    rows = rows.filter("fill_price > 0").withColumn("target_shares", F.expr("target_value div fill_price"))
    rows = rows.withColumn("delta", F.col("target_shares") - F.col("held"))
    side = F.when(F.col("delta") < 0, "SELL").otherwise("BUY")
    quantity = F.when(F.col("delta") < 0, F.least(-F.col("delta"), F.col("held"))).otherwise(F.col("delta"))
    return (
        rows.withColumn("side", side)
        .withColumn("quantity", quantity)
        .filter("quantity > 0")
        .withColumn("fill_price", fill_price(F.col("side"), F.col("price"), params.slippage_bps))
        .select("portfolio_id", "position_key", "symbol", "side", "quantity", "price", "fill_price", "target_shares", "held")
    )


def missing_prices(holdings: DataFrame, targets: DataFrame, prices: DataFrame) -> DataFrame:
    """Symbols needed for execution that have no price."""
    needed = holdings.select("symbol").union(targets.select("symbol")).distinct()
    return needed.join(prices.filter("price is not null").select("symbol"), "symbol", "left_anti")


def _cost(params: LedgerParams) -> Column:
    value = shares(F.col("quantity")) * F.col("fill_price")
    return value + commission(value, params.commission_rate)


def affordable_orders(deltas: DataFrame, accounts: DataFrame, params: LedgerParams) -> DataFrame:
    """Orders that projected cash can pay for: all sales, then buys by key.

    Buys are cut to the shares that cash affords and dropped below the minimum trade. A portfolio whose buys all fit needs no
    sequence: its cash can never run short. For the others ``_within_budget`` searches the buys that do not fit.
    """
    value = shares(F.col("quantity")) * F.col("fill_price")
    sell, buy = F.col("side") == "SELL", F.col("side") == "BUY"
    # Read three times below, so the join behind it is done once and written.
    deltas = materialize(deltas, "deltas")
    net = value - commission(value, params.commission_rate)
    sums = deltas.groupBy("portfolio_id").agg(
        F.sum(F.when(sell, net)).alias("_in"), F.sum(F.when(buy, _cost(params))).alias("_out")
    )
    budget = accounts.join(sums, "portfolio_id").select(
        "portfolio_id",
        (F.col("cash") + F.coalesce("_in", F.lit(0))).cast(T.DecimalType(38, 12)).alias("budget"),
        F.coalesce("_out", F.lit(0)).alias("_out"),
    )
    tight = F.col("_out") > F.col("budget")
    with_budget = deltas.join(budget, "portfolio_id")
    least = F.lit(params.min_trade_value)
    free = with_budget.filter(sell | ~tight).filter(sell | (value >= least)).select(*deltas.columns)
    # A buy that is too small as a whole is too small in part.
    squeezed = with_budget.filter(buy & tight & (value >= least)).select(*deltas.columns, "budget")
    return free.unionByName(_within_budget(squeezed, params).select(*deltas.columns))


def _within_budget(buys: DataFrame, params: LedgerParams) -> DataFrame:
    """Buys by key as far as ``budget`` goes.

    Costs are summed up over all portfolios at once. All buys before the first that exceeds its portfolio's cash are made,
    that one is cut to what is left, and the next round goes on behind it. A cut leaves less than one share's cost, which
    is less than half of the cash, and buys that not even their least part fits are left out before. So the rounds are as
    many as the cuts of one portfolio: a few, whatever the number of buys.
    """
    unit = F.col("fill_price") * F.lit(1 + params.commission_rate)
    needed = F.greatest(F.lit(1), F.ceil(F.lit(params.min_trade_value) / F.col("fill_price")).cast("long"))
    buys = buys.filter("fill_price > 0").withColumns({"_unit": unit, "_cost": _cost(params), "_least": shares(needed) * unit, "cash": F.col("budget")})
    left = in_blocks(buys, ["portfolio_id"], ["position_key"], "squeezed")
    made = []
    while True:
        live = left.filter(F.col("_least") <= F.col("cash"))
        summed = blocked_sum(live, ["portfolio_id"], F.col("_cost"), "_spent")
        broken = summed.filter(F.col("_spent") > F.col("cash")).groupBy("portfolio_id").agg(F.min("_pos").alias("_cut"))
        done = materialize(summed.join(broken, "portfolio_id", "left"), "budget-round")
        made.append(done.filter(F.col("_cut").isNull() | (F.col("_pos") < F.col("_cut"))).drop("_cut", "_spent"))
        over = done.filter(F.col("_pos") == F.col("_cut")).withColumn("_rest", F.col("cash") - (F.col("_spent") - F.col("_cost")))
        over = over.withColumn("quantity", F.expr("_rest div _unit"))
        bought = (F.col("quantity") > 0) & (shares(F.col("quantity")) * F.col("fill_price") >= F.lit(params.min_trade_value))
        made.append(over.filter(bought).drop("_cut", "_spent", "_rest"))
        if over.isEmpty():
            return reduce(DataFrame.unionByName, made)
        paid = F.when(bought, shares(F.col("quantity")) * F.col("_unit")).otherwise(0)
        cash = over.select("portfolio_id", (F.col("_rest") - paid).cast(T.DecimalType(38, 12)).alias("cash"))
        left = done.filter(F.col("_pos") > F.col("_cut")).drop("cash", "_cut", "_spent").join(cash, "portfolio_id")


def sequence_orders(orders: DataFrame, session: Column) -> DataFrame:
    """Sales before buys, each by position key, with ids such as ``2024-05-01-0001`` per portfolio."""
    rank = F.when(F.col("side") == "SELL", 0).otherwise(1)
    key = F.col("position_key")
    numbered = number_rows(orders, ["portfolio_id"], [rank, key], "sequence")
    label = F.concat_ws("-", F.date_format(session, "yyyy-MM-dd"), F.lpad(F.col("sequence").cast("string"), 4, "0"))
    wide = F.concat_ws("-", F.date_format(session, "yyyy-MM-dd"), F.col("sequence").cast("string"))
    return numbered.withColumn("client_order_id", F.when(F.col("sequence") > 9999, wide).otherwise(label))


def no_short(orders: DataFrame, holdings: DataFrame) -> DataFrame:
    """Orders with a risk verdict: a sale beyond the holding of its key is refused."""
    have = holdings.select("portfolio_id", "position_key", F.col("quantity").alias("_held"))
    joined = orders.join(have, ["portfolio_id", "position_key"], "left")
    short = (F.col("side") == "SELL") & (F.col("quantity") > F.coalesce("_held", F.lit(0)))
    return joined.withColumn("accepted", ~short).drop("_held")


def next_session_execution(signals: DataFrame, dates: DataFrame) -> DataFrame:
    """Signals with the session that executes them; ``executed`` is false for the last one."""
    return signals.join(F.broadcast(dates.select("as_of", "execution_session")), "as_of").withColumn(
        "executed", F.col("execution_session").isNotNull()
    )


def period_returns(targets: DataFrame, dates: DataFrame, bars: DataFrame, cost_bps: float = 0.0) -> DataFrame:
    """Factor-portfolio return between consecutive executions, with fractional shares.

    Each target earns open(next execution) / open(execution) - 1 at its weight, less
    turnover x ``cost_bps``. A name without both opens earns 0. This is a closed form; a
    whole-share ledger gives different numbers.
    """
    n = Window.orderBy("as_of")
    periods = dates.filter(F.col("execution_session").isNotNull()).select(
        "as_of",
        F.row_number().over(n).alias("_n"),
        F.col("execution_session").alias("buy_at"),
        F.lead("execution_session").over(n).alias("sell_at"),
    )
    held = targets.select("as_of", "symbol", F.col("weight").cast("double").alias("weight")).join(F.broadcast(periods), "as_of")
    opens = bars.select("symbol", "session", F.col("open").cast("double").alias("open"))
    first = opens.select("symbol", F.col("session").alias("buy_at"), F.col("open").alias("_buy"))
    last = opens.select("symbol", F.col("session").alias("sell_at"), F.col("open").alias("_sell"))
    earned = held.join(first, ["symbol", "buy_at"], "left").join(last, ["symbol", "sell_at"], "left")
    gain = F.coalesce(F.try_divide(F.col("_sell"), F.col("_buy")) - 1, F.lit(0.0))
    gross = earned.groupBy("_n").agg(F.sum(F.col("weight") * gain).alias("gross"))
    now = held.select("_n", "symbol", F.col("weight").alias("_now"))
    was = held.select((F.col("_n") + 1).alias("_n"), "symbol", F.col("weight").alias("_was"))
    moved = now.join(was, ["_n", "symbol"], "full_outer").groupBy("_n").agg(
        F.sum(F.abs(F.coalesce("_now", F.lit(0.0)) - F.coalesce("_was", F.lit(0.0)))).alias("turnover")
    )
    rows = periods.join(gross, "_n", "left").join(moved, "_n", "left").fillna(0.0, ["gross", "turnover"])
    net = F.col("gross") - F.col("turnover") * F.lit(cost_bps / 10_000)
    w = Window.orderBy("as_of").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.filter(F.col("sell_at").isNotNull())
        .withColumn("net", net)
        .select(
            "as_of", "buy_at", "sell_at", "gross", "turnover", "net",
            F.exp(F.sum(F.log1p("net")).over(w)).alias("growth"),
        )
    )
