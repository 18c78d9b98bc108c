"""Plain parameter objects, checked on the driver before any plan is built."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta
from decimal import Decimal


class ParameterError(ValueError):
    """A parameter is outside its allowed range."""


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ParameterError(message)


@dataclass(frozen=True)
class MomentumParams:
    lookback: int = 252
    skip: int = 21
    top_n: int = 10
    min_price: float = 10.0
    liquidity_window: int = 20
    min_dollar_volume: float = 20_000_000.0

    def __post_init__(self) -> None:
        _require(self.skip >= 0, "skip must be >= 0")
        _require(self.lookback > self.skip, "lookback must be > skip")
        _require(self.top_n > 0, "top_n must be > 0")
        _require(self.min_price >= 0, "min_price must be >= 0")
        _require(self.min_dollar_volume >= 0, "min_dollar_volume must be >= 0")
        _require(self.liquidity_window > 0, "liquidity_window must be > 0")


@dataclass(frozen=True)
class LedgerParams:
    initial_cash: Decimal = Decimal("100000")
    commission_rate: Decimal = Decimal("0")
    slippage_bps: Decimal = Decimal("0")
    min_trade_value: Decimal = Decimal("0")
    risk_free_rate: Decimal = Decimal("0")
    frequency: str = "MONTHLY"

    def __post_init__(self) -> None:
        _require(self.initial_cash > 0, "initial_cash must be > 0")
        for name in ("commission_rate", "slippage_bps", "min_trade_value", "risk_free_rate"):
            _require(getattr(self, name) >= 0, f"{name} must be >= 0")
        _require(self.frequency == "MONTHLY", f"rebalance frequency {self.frequency} is not implemented")


@dataclass(frozen=True)
class WarmupBounds:
    """Dates that split a run into history, signals and measured performance."""

    mode: str
    warmup_start: date
    calendar_start: date
    signal_start: date | None
    performance_start: date
    end: date
    warmup_sessions: int


def warmup_start(start: date, lookback: int) -> date:
    """Calendar day from which history is loaded: two lookbacks plus a margin of 40 days."""
    return start - timedelta(days=2 * lookback + 40)


def warmup_bounds(
    start: date,
    end: date,
    lookback: int | None,
    signal_start: date | None = None,
    default_sessions: int = 1,
) -> WarmupBounds:
    """Without ``signal_start`` the first signal needs lookback + 1 sessions inside
    [start, end]; with it, history before that date is warm-up only and equity starts there."""
    _require(start <= end, "start must be <= end")
    if signal_start is not None:
        _require(start <= signal_start <= end, "signal_start must lie in [start, end]")
    has_lookback = lookback is not None and lookback > 0
    history = warmup_start(start, lookback) if has_lookback else start
    if signal_start is None:
        need = lookback + 1 if has_lookback else default_sessions
        return WarmupBounds("in_window", history, start, None, start, end, need)
    return WarmupBounds("explicit_signal", history, start, signal_start, signal_start, end, 1)


def minimum_expected_bars(days: int) -> int:
    """Floor on bars for a range of ``days``: none below a year, else max(252, half the days)."""
    return 0 if days < 365 else max(252, days // 2)
