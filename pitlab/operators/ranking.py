"""Ranks within a group that may itself be a third of the table."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A row in so many is drawn, by its hash, as a place where a group may be cut.
DRAWN_ONE_IN = 4096
#: Binary steps to find a row's bucket; a group is cut into at most 2 ** CUT_STEPS buckets.
CUT_STEPS = 10
#: Copies of a group's cuts, so that the rows of a hot group meet them in many tasks.
CUT_COPIES = 16


def top_n(df: DataFrame, keys: Sequence[str], value: str, tie: str, n: int, rank_as: str = "rank") -> DataFrame:
    """The n greatest values per key, ties by ``tie`` ascending, ranked from 1.

    ``row_number() <= n`` lets Spark keep only n rows per key in each map task, so the
    shuffle carries tasks x n rows of a hot key.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc(), F.col(tie).asc())
    return df.withColumn(rank_as, F.row_number().over(w).cast("long")).filter(F.col(rank_as) <= n)


def _cuts(rows: DataFrame, drawn_one_in: int, steps: int) -> DataFrame:
    """(_g, _cuts): drawn places of each group, ascending. Groups without a drawn row are missing."""
    rank = Window.partitionBy("_g").orderBy("_h")
    drawn = rows.select("_g", F.col("_row.at").alias("_at"), F.xxhash64("_row.at", F.lit("cut")).alias("_h")).filter(F.pmod("_h", F.lit(drawn_one_in)) == 0)
    few = drawn.withColumn("_n", F.row_number().over(rank)).filter(F.col("_n") < 2**steps)
    return few.groupBy("_g").agg(F.array_sort(F.collect_set("_at")).alias("_cuts"))


def _bucket(steps: int) -> Column:
    """How many of ``_cuts`` lie before the row, by binary search. A place beyond the last cut reads as NULL."""
    halves = F.array(*[F.lit(2**k) for k in range(steps - 1, -1, -1)])
    return F.aggregate(halves, F.lit(0), lambda at, half: F.when(F.get(F.col("_cuts"), at + half - 1) < F.col("_row.at"), at + half).otherwise(at))


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], number_as: str, drawn_one_in: int = DRAWN_ONE_IN, steps: int = CUT_STEPS
) -> DataFrame:
    """Numbers the rows of each key 1..N in ``order``, ascending with NULL first, with no task holding a whole key.

    One lazy plan. Rows drawn by hash give each group its cuts; between two cuts lies a bucket of some
    ``drawn_one_in`` rows, or of N / 2 ** steps in a larger group. A row's number is its place in its bucket plus the counts
    of the buckets before. The cuts say where the work is split and never what a number is. ``order`` must be total up to
    rows that are interchangeable, and ``df`` the same each time it is evaluated: the cuts read it once more. Counts and
    rows share one shuffle.

    Keys may be NULL (one group). An empty table gives an empty table.
    """
    # A struct of the keys is never NULL itself, and NULL fields are equal, so NULL keys join.
    group = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.lit(0).alias("all"))
    # What sorts travels with its row in one column: then the counts need the same columns as the rows, and Spark sees one shuffle.
    maps = [f.name for f in df.schema if re.search("map<|variant", f.dataType.simpleString())]
    kept = [c for c in df.columns if c not in maps]
    row = F.struct(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("at"), F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)], F.lit(0).alias("all")).alias("kept"))
    rows = df.select(group.alias("_g"), row.alias("_row"), *maps)
    cuts = _cuts(rows, drawn_one_in, steps).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(CUT_COPIES - 1))))
    rows = rows.withColumn("_copy", F.pmod(F.xxhash64("_row.at"), F.lit(CUT_COPIES)).cast("int"))
    placed = rows.join(cuts, ["_g", "_copy"], "left").withColumn("_bucket", F.coalesce(_bucket(steps), F.lit(0))).drop("_cuts", "_copy")
    within = Window.partitionBy("_g", "_bucket").orderBy("_row")
    numbered = placed.withColumn("_n", F.row_number().over(within))
    counts = numbered.groupBy("_g", "_bucket").agg(F.max("_n").cast("long").alias("_size"))
    earlier = Window.partitionBy("_g").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_g", "_bucket", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    back = {c: F.col(f"_row.kept.c{i}").alias(c) for i, c in enumerate(kept)}
    found = numbered.join(before, ["_g", "_bucket"])
    return found.select(*[back.get(c, F.col(c)) for c in df.columns], (F.col("_before") + F.col("_n")).cast("long").alias(number_as))


def descending(value: str, kind: T.DataType) -> list[Column]:
    """Expressions whose ascending order is the descending order of a number, NULL last and NaN first, as Spark sorts."""
    column = F.col(value)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return [column.isNull(), ~F.isnan(column), -column]
    if isinstance(kind, T.DecimalType):
        return [column.isNull(), -column]
    return [column.isNull(), F.bitwise_not(column)]  # -v - 1, which no whole number overflows


def full_rank(
    df: DataFrame, keys: Sequence[str], value: str, tie: str, rank_as: str = "rank", drawn_one_in: int = DRAWN_ONE_IN, steps: int = CUT_STEPS
) -> DataFrame:
    """Unique rank 1..N per key, the number ``value`` descending then ``tie`` ascending."""
    order = [*descending(value, df.schema[value].dataType), F.col(tie)]
    return number_rows(df, keys, order, rank_as, drawn_one_in, steps)
