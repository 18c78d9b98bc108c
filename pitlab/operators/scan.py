"""Running values of a linear recurrence as an associative scan.

``x[i] = scale[i] * x[i-1] + shift[i]`` depends on all earlier rows, but a row is a map x -> scale * x + shift, and two such
maps make one map of the same kind. Maps are composed by doubling: after step k a row's map covers the 2**k rows up to it, and
the next step takes the map that lies 2**k rows back. All steps share one window, so Spark shuffles and sorts once, and
nothing leaves the JVM.

A group of any size is cut into blocks, as ``place_in_group`` spreads it over range partitions. Rows are composed within
their block, blocks by their totals, and each row takes what comes in from the blocks before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlab.operators.fold import place_in_group

#: Factors keep 18 decimals and may reach 999,999; values keep 10. An overflow stops the job.
FACTOR = T.DecimalType(24, 18)
VALUE = T.DecimalType(28, 10)

_A, _B = "_scale", "_shift"


def in_blocks(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], label: str) -> DataFrame:
    """``rows`` sorted over range partitions and written, with ``_part`` and ``_pos``: the input of ``blocked_scan``."""
    placed = place_in_group(rows, keys, order, label)
    return placed.withColumn("_part", F.shiftright("_pos", 33)).drop("_place")


def blocked_sum(blocks: DataFrame, keys: Sequence[str], value: Column, sum_as: str) -> DataFrame:
    """Adds ``sum_as``: the sum of ``value`` over a group's rows up to each row, with no task holding a whole group."""
    group = [*keys, "_part"]
    up_to = Window.partitionBy(*group).orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy(*group).agg(F.sum(value).alias("_total"))
    ahead = totals.select(*group, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_in"))
    return blocks.join(ahead, group).withColumn(sum_as, F.sum(value).over(up_to) + F.col("_in")).drop("_in")


def _composed(maps: DataFrame, group: Sequence[str], order: Sequence[Column | str], kind: T.DataType) -> DataFrame:
    """``_scale`` and ``_shift`` of each row composed with those of all earlier rows of its group."""
    longest = maps.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    w = Window.partitionBy(*group).orderBy(*order)
    back = 1
    while back < longest:
        earlier = maps.withColumns({"_a": F.lag(_A, back).over(w), "_b": F.lag(_B, back).over(w)})
        maps = earlier.withColumns(
            {
                _A: F.when(F.col("_a").isNull(), F.col(_A)).otherwise((F.col(_A) * F.col("_a")).cast(FACTOR)),
                _B: F.when(F.col("_a").isNull(), F.col(_B)).otherwise((F.col(_A) * F.col("_b")).cast(kind) + F.col(_B)).cast(kind),
            }
        ).drop("_a", "_b")
        back *= 2
    return maps


def _maps(rows: DataFrame, scale: Column, shift: Column, kind: T.DataType) -> DataFrame:
    return rows.withColumns({_A: scale.cast(FACTOR), _B: shift.cast(kind)})


def linear_scan(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], scale: Column, shift: Column, value_as: str, start: Column | None = None, kind: T.DataType = VALUE
) -> DataFrame:
    """Adds ``value_as``: the recurrence of each group in ``order``, from ``start`` (0).

    For groups that something else bounds, such as one row per day: a group is one task's window. ``rows`` is counted once
    before.
    """
    done = _composed(_maps(rows, scale, shift, kind), keys, order, kind)
    first = F.lit(0) if start is None else start
    return done.withColumn(value_as, ((F.col(_A) * first.cast(kind)).cast(kind) + F.col(_B)).cast(kind)).drop(_A, _B)


def blocked_scan(
    blocks: DataFrame, keys: Sequence[str], scale: Column, shift: Column, value_as: str, before_as: str | None = None, kind: T.DataType = VALUE
) -> DataFrame:
    """Adds ``value_as``: the recurrence of each group from 0, with no task holding a whole group; ``before_as`` is the row before's.

    ``blocks`` comes from ``in_blocks``. A group has at most one block per range partition, so the totals of its blocks
    are few.
    """
    group = [*keys, "_part"]
    done = _composed(_maps(blocks, scale, shift, kind), group, ["_pos"], kind)
    totals = done.groupBy(*group).agg(F.max_by(_A, "_pos").alias(_A), F.max_by(_B, "_pos").alias(_B))
    over = Window.partitionBy(*keys).orderBy("_part")
    # From 0 a composed map's value is its shift.
    ahead = _composed(totals, keys, ["_part"], kind).select(*group, F.coalesce(F.lag(_B).over(over), F.lit(0)).cast(kind).alias("_in"))
    done = done.join(ahead, group).withColumn(value_as, ((F.col(_A) * F.col("_in")).cast(kind) + F.col(_B)).cast(kind))
    if before_as is not None:
        done = done.withColumn(before_as, F.coalesce(F.lag(value_as).over(Window.partitionBy(*group).orderBy("_pos")), "_in"))
    return done.drop(_A, _B, "_in")
