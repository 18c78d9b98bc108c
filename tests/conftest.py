from __future__ import annotations

import sys
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

from pitlab.schemas import BARS  # noqa: E402
from pitlab.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(4, shuffle_partitions=4, app="pitlab-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_bars(spark):
    """Bars from {symbol: [(day, close, volume, adjusted)]}; days count from 2020-01-01."""

    def build(series):
        rows = []
        for symbol, points in series.items():
            for day, close, volume, adjusted in points:
                d = date(2020, 1, 1) + timedelta(days=day)
                ts = datetime(d.year, d.month, d.day, 14, 30, tzinfo=timezone.utc)
                px = Decimal(str(close))
                rows.append((symbol, ts, d, px, px, px, px, None if adjusted is None else Decimal(str(adjusted)), volume))
        return spark.createDataFrame(rows, BARS)

    return build


def ramp(n, start=100.0, step=1.0, volume=1000, first=0):
    """A straight line of closes on consecutive days."""
    return [(first + i, start + step * i, volume, start + step * i) for i in range(n)]
