"""One-row results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def side_by_side(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The columns of several one-row frames in one row, the others as scalar subqueries and not as joins without a key."""
    wide = first
    for k, other in enumerate(others):
        wide = wide.withColumn(f"_{k}", other.select(F.struct(*other.columns)).scalar())
    taken = [F.col(f"_{k}.{c}").alias(c) for k, other in enumerate(others) for c in other.columns]
    return wide.select(*first.columns, *taken)
