"""Row checks that collect every violated rule of a row, not just the first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICE_COLUMNS = ("open", "high", "low", "close", "adjusted_close")


def issues(rules: list[tuple[Column, str]]) -> Column:
    """ARRAY<STRING> of the messages whose condition is true. NULL conditions do not fire."""
    found = F.array(*[F.when(cond, F.lit(message)) for cond, message in rules])
    return F.filter(found, lambda m: m.isNotNull())


def breaks(rules: list[tuple[Column, str]]) -> Column:
    """Whether any condition is true: what ``issues`` would find, without its texts."""
    return F.coalesce(reduce(lambda a, b: a | b, (cond for cond, _ in rules)), F.lit(False))


def bar_rules(naive: Column | None = None) -> list[tuple[Column, str]]:
    c = F.col
    rules = [(F.coalesce(F.trim(c("symbol")), F.lit("")) == "", "symbol must not be empty")]
    if naive is not None:
        rules.append((naive, "timestamp must be timezone-aware"))
    rules += [(c(name) < 0, f"{name} must be non-negative") for name in PRICE_COLUMNS]
    rules += [(c("high") < c(name), f"high must be >= {name}") for name in ("low", "open", "close")]
    rules += [(c("low") > c(name), f"low must be <= {name}") for name in ("open", "close")]
    rules.append((c("volume") < 0, "volume must be non-negative"))
    return rules


def strict_bar_rules(naive: Column | None = None) -> list[tuple[Column, str]]:
    """Downloaded history: adjusted close is required, and then all five prices must be > 0."""
    present = F.col("adjusted_close").isNotNull()
    rules = bar_rules(naive)
    rules.append((~present, "adjusted_close is required"))
    rules += [(present & (F.col(name) <= 0), f"{name} must be positive") for name in PRICE_COLUMNS]
    return rules


def format_issue(message: Column, row: Column, symbol: Column, ts: Column, source: Column) -> Column:
    """``message row=… symbol=… timestamp=… source=…``; missing parts are left out."""

    def part(name: str, value: Column) -> Column:
        return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{name}="), value))

    stamp = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat_ws(
        " ",
        message,
        part("row", row.cast("string")),
        part("symbol", symbol),
        part("timestamp", F.concat(stamp, F.lit("+00:00"))),
        part("source", source),
    )


def _blank(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name)), F.lit("")) == ""


def _outside(name: str, allowed: tuple[str, ...]) -> Column:
    return F.col(name).isNull() | ~F.col(name).isin(*allowed)


# The states and kinds that each column may hold.
ORDER_SIDES = ("BUY", "SELL")
ORDER_TYPES = ("MARKET", "LIMIT")
ORDER_STATUSES = (
    "CREATED",
    "VALIDATED",
    "SUBMITTED",
    "ACKNOWLEDGED",
    "PARTIALLY_FILLED",
    "FILLED",
    "CANCELLED",
    "REJECTED",
    "FAILED",
)
SECURITY_STATUSES = ("ACTIVE", "DELISTED")
TICKER_SCHEMES = ("listing", "yahoo")
ACTION_TYPES = (
    "NO_ACTION",
    "SPLIT",
    "REVERSE_SPLIT",
    "CASH_DIVIDEND",
    "RENAME",
    "DELISTING",
    "CASH_ACQUISITION",
    "SHARE_CONVERSION",
)


def table_rules(table: str) -> list[tuple[Column, str]]:
    """Constraints of one table, as (condition that is a violation, message)."""
    c = F.col
    rules: dict[str, list[tuple[Column, str]]] = {
        "orders": [
            (_blank("symbol"), "symbol must not be empty"),
            (_outside("side", ORDER_SIDES), "unknown side"),
            (~F.coalesce(c("quantity") > 0, F.lit(False)), "quantity must be > 0"),
            ((c("order_type") == "LIMIT") & c("limit_price").isNull(), "LIMIT order requires limit_price"),
            ((c("order_type") == "LIMIT") & (c("limit_price") <= 0), "limit_price must be > 0"),
            ((c("order_type") == "MARKET") & c("limit_price").isNotNull(), "MARKET order must not have limit_price"),
            (_outside("order_type", ORDER_TYPES), "unknown order_type"),
            (_outside("status", ORDER_STATUSES), "unknown status"),
        ],
        "fills": [
            (_blank("order_id"), "order_id must not be empty"),
            (_blank("symbol"), "symbol must not be empty"),
            (~F.coalesce(c("quantity") > 0, F.lit(False)), "quantity must be > 0"),
            (c("price") < 0, "price must be >= 0"),
            (c("commission") < 0, "commission must be >= 0"),
            (c("slippage") < 0, "slippage must be >= 0"),
            (c("cash") < 0, "cash must be >= 0"),
            (c("position_quantity") < 0, "position_quantity must be >= 0"),
        ],
        "positions": [
            (_blank("symbol"), "symbol must not be empty"),
            (c("quantity") < 0, "quantity must be >= 0"),
            (c("average_price") < 0, "average_price must be >= 0"),
            (c("market_price") < 0, "market_price must be >= 0"),
        ],
        "targets": [
            (_blank("position_key"), "position_key must not be empty"),
            (c("weight") < 0, "weight must be >= 0"),
            (c("weight") > 1, "weight must be <= 1"),
        ],
        "signals": [
            (_blank("symbol"), "symbol must not be empty"),
            (c("rank") < 0, "rank must be >= 0"),
        ],
        "memberships": [
            (_blank("symbol"), "symbol must not be empty"),
            (c("end_date").isNotNull() & (c("start_date") >= c("end_date")), "impossible date range"),
        ],
        "securities": [
            (_blank("seed_key"), "seed_key must not be empty"),
            (_blank("display_name"), "display_name must not be empty"),
            (_outside("status", SECURITY_STATUSES), "unknown status"),
        ],
        "tickers": [
            (_blank("seed_key"), "seed_key must not be empty"),
            (_blank("ticker"), "ticker must not be empty"),
            (_outside("scheme", TICKER_SCHEMES), "unknown scheme"),
            (c("valid_to").isNotNull() & (c("valid_from") >= c("valid_to")), "valid_from must be before valid_to"),
        ],
        "identities": [
            (_outside("status", ("RESOLVED", "UNRESOLVED")), "unknown status"),
            ((c("status") == "RESOLVED") & c("security_id").isNull(), "RESOLVED requires security_id"),
            ((c("status") == "UNRESOLVED") & c("security_id").isNotNull(), "UNRESOLVED forbids security_id"),
        ],
        "actions": [
            (_outside("action_type", ACTION_TYPES), "unknown action_type"),
            (
                c("action_type").isin("SPLIT", "REVERSE_SPLIT") & ~F.coalesce(c("factor") > 0, F.lit(False)),
                "split requires factor > 0",
            ),
            ((c("action_type") == "CASH_DIVIDEND") & c("amount").isNull(), "cash dividend requires amount"),
            (c("amount") < 0, "amount must be >= 0"),
        ],
        "equity": [
            (c("equity") < 0, "equity must be >= 0"),
            (c("cash") < 0, "cash must be >= 0"),
        ],
        "stocks": [
            (_blank("symbol"), "symbol must not be empty"),
            (_blank("exchange"), "exchange must not be empty"),
        ],
    }
    if table not in rules:
        raise ValueError(f"no constraints are declared for table {table}")
    return rules[table]
