"""Ordered folds over groups of any size.

Some results depend on every earlier row of a group: a cash account that may refuse an
order, for instance. Such a chain cannot be a window. Spark partitions by key and sorts;
the fold then streams over the sorted Arrow batches of a partition and keeps nothing but
the state of the current group, so memory does not depend on group size.

Time could still: one group may hold a third of all rows. Groups longer than
``chunk_rows`` therefore run in rounds. The rows are range-partitioned by (keys, order), so
a long group spans many partitions, and written once. Round r folds chunk r of every group
at once and hands the small state of each group to round r + 1 through a written table. No
task sees more than one chunk of a group, and a lost executor repeats only its own chunk.
"""

from __future__ import annotations

import json
from collections import namedtuple
from collections.abc import Callable, Iterator, Sequence
from decimal import Decimal
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlab.session import materialize

Begin = Callable[[tuple], dict]
Advance = Callable[[dict, tuple], tuple]
DEFAULT_CHUNK_ROWS = 1_000_000
_STATE = "_state"
_POS = "_pos"


def ordered_fold(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    begin: Begin,
    advance: Advance,
    output: T.StructType,
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
    label: str = "fold",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Fold each group in ``order``, one output row per input row.

    ``begin(row)`` makes the state of a group from its first row, ``advance(state, row)``
    changes the state and returns the output values. Rows come as named tuples; a state
    holds numbers, texts, decimals, and lists or dicts of them. ``order`` must be total
    within a group up to rows that are interchangeable. Decimals are rounded to their output type. With ``columns`` the other
    columns of ``output`` but the keys are neither rounded nor given.
    """
    keys, order = list(keys), list(order)
    wanted = [n for n in output.fieldNames() if columns is None or n in columns or n in keys]
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    longest = sizes.agg(F.max("_n")).first()[0] or 0
    if longest <= chunk_rows:
        return _stream(rows, keys, order, begin, advance, output, wanted, keep_state=False).drop(_STATE)

    placed = place_in_group(rows, keys, order, label)
    numbered = placed.withColumn("_round", F.floor(F.col("_place") / F.lit(chunk_rows)) + 1)
    staged = materialize(numbered.drop("_place"), f"{label}-chunks", ("_round",))

    done, state = [], None
    for r in range(1, -(-longest // chunk_rows) + 1):
        chunk = staged.filter(F.col("_round") == r).drop("_round").withColumn(_STATE, F.lit(None).cast("string"))
        if state is not None:
            live = chunk.select(*keys).distinct()
            chunk = chunk.unionByName(state.join(live, keys, "left_semi"), allowMissingColumns=True)
        result = materialize(_stream(chunk, keys, [_POS], begin, advance, output, wanted, keep_state=True), f"{label}-round")
        done.append(result.filter(F.col(_STATE).isNull()).drop(_STATE))
        state = result.filter(F.col(_STATE).isNotNull()).select(*keys, _STATE, F.lit(-1).cast("long").alias(_POS))
    return reduce(lambda a, b: a.unionByName(b), done)


def place_in_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], label: str) -> DataFrame:
    """Adds ``_place``, the position of each row in its group from 0, and ``_pos``.

    The rows are range-partitioned by (keys, order), so a group of any size spreads over
    many partitions, and written once. The place is the number of rows of the group in
    earlier partitions plus the distance from its first row in this one; only those counts
    are shuffled and summed.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    stored = materialize(sorted_rows.withColumn(_POS, F.monotonically_increasing_id()), f"{label}-rows")
    # The upper bits of the id are the partition.
    located = stored.withColumn("_part", F.shiftright(_POS, 33))
    runs = located.groupBy(*keys, "_part").agg(F.min(_POS).alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    place = F.col("_before") + F.col(_POS) - F.col("_first")
    return located.join(runs, [*keys, "_part"]).withColumn("_place", place).drop("_part", "_first", "_before")


def _arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.DecimalType):
        return pa.decimal128(kind.precision, kind.scale)
    simple = {T.LongType: pa.int64(), T.StringType: pa.string(), T.DateType: pa.date32(), T.BooleanType: pa.bool_()}
    return simple[type(kind)]


def _values(column: pa.Array) -> list:
    """What ``to_pylist`` gives, without a scalar object per cell for the kinds that can do without."""
    kind = column.type
    if pa.types.is_decimal(kind):
        return [None if text is None else Decimal(text) for text in _values(column.cast(pa.string()))]
    if pa.types.is_string(kind) or pa.types.is_date32(kind) or (pa.types.is_integer(kind) and not column.null_count):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def dump_state(state: dict) -> str:
    return json.dumps(state, default=lambda d: {"$decimal": str(d)})


def load_state(text: str) -> dict:
    return json.loads(text, object_hook=lambda d: Decimal(d["$decimal"]) if "$decimal" in d else d)


def _rounded(values: Sequence, kind: T.DataType) -> Sequence:
    if not isinstance(kind, T.DecimalType):
        return values
    step = Decimal(1).scaleb(-kind.scale)
    return [None if v is None else v.quantize(step) for v in values]


def _stream(
    rows: DataFrame, keys: list[str], order: list[str], begin: Begin, advance: Advance, output: T.StructType, wanted: list[str], keep_state: bool
) -> DataFrame:
    """Partition by key, sort, and fold batch by batch.

    With ``keep_state`` a row at position -1 carries the state a group starts from, and a
    last row per group carries its state on; it is NULL in every column but the keys.
    """
    fields = [T.StructField(n, output[n].dataType) for n in wanted] + [T.StructField(_STATE, T.StringType())]
    arrow = pa.schema([(f.name, _arrow_type(f.dataType)) for f in fields])
    names, width = rows.columns, len(output)
    given = [*map(output.fieldNames().index, wanted), width]
    record = namedtuple("record", [n.lstrip("_") if n.startswith("_") else n for n in names])
    at = [names.index(k) for k in keys]
    key_out = [output.fieldNames().index(k) for k in keys]
    pos_at = names.index(_POS) if keep_state else -1
    state_at = names.index(_STATE) if keep_state else -1

    def carried(key: tuple, state: dict) -> tuple:
        row = [None] * width
        for i, value in zip(key_out, key):
            row[i] = value
        return (*row, dump_state(state))

    def pack(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(_rounded(columns[i], f.dataType), type=a.type) for i, f, a in zip(given, fields, arrow)], schema=arrow)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for row in map(record._make, zip(*(_values(column) for column in batch.columns))):
                mine = tuple(row[i] for i in at)
                if mine != key:
                    if keep_state and key is not None:
                        out.append(carried(key, state))
                    key, state = mine, None
                if keep_state and row[pos_at] == -1:
                    state = load_state(row[state_at])
                    continue
                if state is None:
                    state = begin(row)
                out.append((*advance(state, row), None))
            if out:
                yield pack(out)
        if keep_state and key is not None:
            yield pack([carried(key, state)])

    arranged = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return arranged.mapInArrow(fold, schema=T.StructType(fields))
