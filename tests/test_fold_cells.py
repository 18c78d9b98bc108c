"""Cells of Arrow batches as the fold takes them."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pyarrow as pa

from pitlab.operators.fold import _values

D = Decimal


def test_cells_as_to_pylist_gives_them():
    columns = [
        pa.array([D("1.000000"), None, D("-0.000001"), D("123456789012.000001")], pa.decimal128(18, 6)),
        pa.array([D("0E-10"), D("-5.0000000000")], pa.decimal128(28, 10)),
        pa.array(["a", None, "", "\u00e9"]),
        pa.array([date(1, 1, 1), None, date(9999, 12, 31)]),
        pa.array([1, 2**62]),
        pa.array([1, None, -(2**62)]),
        pa.array([True, None]),
    ]
    for column in columns:
        made, want = _values(column), column.to_pylist()
        assert made == want and [(type(x), str(x)) for x in made] == [(type(x), str(x)) for x in want]
