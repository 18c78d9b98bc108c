"""Keep-first de-duplication, merging and idempotent append.

All of these are aggregations, so each map task first folds its own copies of a
key. A key that holds a third of all rows reaches the shuffle as one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], count_as: str | None = None) -> DataFrame:
    """The first row of each key in ``order``; optionally with the number of rows of the key.

    ``order`` is ascending and must be total within a key up to identical rows, because
    Spark has no input order to fall back on.
    """
    rest = [name for name in df.columns if name not in keys]
    position = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    aggregates = [F.min_by(F.struct(*rest), position).alias("_row")]
    if count_as:
        aggregates.append(F.count(F.lit(1)).alias(count_as))
    kept = df.groupBy(*keys).agg(*aggregates)
    extra = [count_as] if count_as else []
    return kept.select(*keys, *[F.col(f"_row.{name}").alias(name) for name in rest], *extra).select(*df.columns, *extra)


def dedupe_bars(bars: DataFrame, order: Sequence[Column | str], count_as: str | None = None) -> DataFrame:
    """One bar per (symbol, ts): the first in ``order`` (source rank, then row number)."""
    return keep_first(bars, ("symbol", "ts"), order, count_as)


def merge_bars(*groups: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Union by (symbol, ts); an earlier group wins, then ``order`` inside a group."""
    ranked = [g.withColumn("_group", F.lit(i)) for i, g in enumerate(groups)]
    together = reduce(lambda a, b: a.unionByName(b), ranked)
    rest = [name for name in groups[0].columns if name not in ("symbol", "ts", *order)]
    return keep_first(together, ("symbol", "ts"), ["_group", *order, *rest]).drop("_group")


def upsert_new(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], null_safe: Sequence[str] = ()) -> DataFrame:
    """Rows of ``incoming`` whose key is not stored yet (insert, else do nothing).

    ``null_safe`` keys match NULL with NULL, such as the end of an open interval.
    """
    left, right = incoming.alias("n"), existing.select(*keys, *null_safe).alias("o")
    cond = [F.col(f"n.{k}") == F.col(f"o.{k}") for k in keys]
    cond += [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in null_safe]
    return left.join(right, cond, "left_anti")


def upsert_bars(existing: DataFrame, incoming: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Idempotent append. Returns (rows to insert, per-symbol inserted and duplicate counts).

    Of the stored table only the sessions between the first and last incoming one are read.
    """
    first = keep_first(incoming, ("symbol", "ts"), order, count_as="_copies")
    span = incoming.agg(F.min("session").alias("lo"), F.max("session").alias("hi"))
    near = (F.col("session") >= span.select("lo").scalar()) & (F.col("session") <= span.select("hi").scalar())
    stored = existing.filter(near).select("symbol", "ts").withColumn("_stored", F.lit(True))
    tagged = first.join(stored, ["symbol", "ts"], "left")
    fresh = tagged.filter(F.col("_stored").isNull()).drop("_stored", "_copies")
    counts = tagged.groupBy("symbol").agg(
        F.sum("_copies").alias("rows_read"),
        F.count_if(F.col("_stored").isNull()).alias("inserted"),
        (F.sum("_copies") - F.count_if(F.col("_stored").isNull())).alias("duplicates"),
    )
    return fresh, counts


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key."""
    rest = [name for name in df.columns if name not in keys]
    position = F.struct(*[F.col(o) for o in order])
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), position).alias("_row"))
    return kept.select(*keys, *[F.col(f"_row.{name}").alias(name) for name in rest])
