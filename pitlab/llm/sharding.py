"""Shards of near equal bytes by histogram sort.

Rows have a place in one total order: a hash of the text, a hash of the id, a hash of the row's number. Equal texts are
neighbours there. The order is cut at boundaries that are found by counting: candidate boundaries go to all tasks, each
task counts bytes and rows between them in its part of the keys, and the counts are added up. Where a shard's share of the
bytes ends inside an interval, and where an interval holds more rows than a piece may, the interval gets new candidates,
until every cut is within the tolerance. Then the rows are exchanged once, by piece: a piece is a run of the order
inside one shard, of bounded size, and the counts already say how many rows of the shard lie before it.

A boundary between texts is taken where one is within the tolerance, or misses by no more than half the largest row, as any
cut may. So a group of equal texts is cut only if it is too large for that: at most once per shard border.

What the driver holds are the intervals: ``CELLS`` at first, and ``FAN`` more for each one that is refined, that is for each
cut and for each piece beyond the first cells. Keys are written to the shared folder once, so each count and the exchange
see the same rows, also if an executor is lost.

Defined cases. A null text is an empty one, of size 1. Rows that repeat an id, or a null id, are rows of their own; rows equal in
all hashes stay in one piece. With fewer rows than shards some shards stay empty. A row larger than a shard's share fills
it. No rows give no rows. Other columns are carried, whatever their names; columns named size, shard or slot are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitlab.session import materialize

SHARDS = 16
#: A cut may miss its share by this part of a shard.
TOLERANCE = 0.001
#: Intervals of the first count, and new intervals where one is refined.
CELLS, FAN = 1 << 12, 1 << 6
#: Rows of a piece, at most and in small tables.
PIECE_ROWS, PIECES = 1 << 20, 256

_TOP = (1 << 63) - 1
_LOWEST = (0, 0, 0)
_KEYS = ("shard_key_text", "shard_key_id", "shard_key_row")

Key = tuple[int, int, int]


@dataclass(frozen=True)
class Interval:
    """Keys from ``low`` on, up to the next interval; ``least`` and ``most`` bound each part of the keys counted in it."""

    low: Key
    size: int
    rows: int
    largest: int
    least: Key
    most: Key

    @property
    def whole(self) -> bool:
        """It cannot be cut."""
        return self.rows < 2 or self.least == self.most

    @property
    def one_text(self) -> bool:
        return self.least[0] == self.most[0]


def text_size(text: str = "text") -> Column:
    """UTF-8 bytes of a text and 1 for its end."""
    return F.octet_length(F.coalesce(F.col(text).cast("string"), F.lit(""))).cast("long") + 1


def _hashed(column: Column) -> Column:
    return F.xxhash64(column).bitwiseAND(_TOP)


def keyed(docs: DataFrame, carry: list[Column], size: Column) -> DataFrame:
    """The carried columns, a size and the three keys of every row, written once."""
    keys = (_hashed(F.coalesce(F.col("text").cast("string"), F.lit(""))), _hashed(F.col("doc_id")), _hashed(F.monotonically_increasing_id()))
    return materialize(docs.select(F.struct(*carry).alias("row"), size.alias("size"), *(k.alias(name) for k, name in zip(keys, _KEYS))), "shard-keys")


def place(keys: list[np.ndarray], bounds: list[np.ndarray]) -> np.ndarray:
    """For each key the number of bounds that are not above it. Bounds are sorted."""
    low = np.searchsorted(bounds[0], keys[0], side="left")
    found = np.searchsorted(bounds[0], keys[0], side="right")
    if len(keys) == 1:
        return found
    # Only keys that share their first part with a bound need the others; those bounds lie side by side.
    for start in np.unique(low[low < found]):
        rows = np.flatnonzero((low == start) & (low < found))
        stop = found[rows[0]]
        found[rows] = start + place([k[rows] for k in keys[1:]], [b[start:stop] for b in bounds[1:]])
    return found


def _columns(bounds: list[Key]) -> list[np.ndarray]:
    return [np.array([b[k] for b in bounds], dtype=np.int64) for k in range(len(_KEYS))]


def count_between(keys: DataFrame, bounds: list[Key], wanted: list[bool]) -> dict[int, Interval]:
    """Exact bytes and rows of each wanted interval between ``bounds``, its largest row, and what bounds its keys."""
    columns, kept = _columns(bounds), np.array([False, *wanted])
    fields = ["bin", "size", "rows", "largest", *(f"{end}_{k}" for end in ("least", "most") for k in range(len(_KEYS)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(kept)), np.int64)
        ends = np.stack([np.full((len(_KEYS), len(kept)), _TOP), np.full((len(_KEYS), len(kept)), -1)])
        for batch in batches:
            size, *own = (batch.column(k).to_numpy() for k in range(1 + len(_KEYS)))
            bins = place(own, columns)
            rows = np.flatnonzero(kept[bins])
            bins = bins[rows]
            np.add.at(total[0], bins, size[rows])
            np.add.at(total[1], bins, 1)
            np.maximum.at(total[2], bins, size[rows])
            for k, key in enumerate(own):
                np.minimum.at(ends[0, k], bins, key[rows])
                np.maximum.at(ends[1, k], bins, key[rows])
        used = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (used, *total[:, used], *ends[0][:, used], *ends[1][:, used])], names=fields)

    local = keys.select("size", *_KEYS).mapInArrow(run, ", ".join(f"{f} long" for f in fields))
    low, high = fields[4 : 4 + len(_KEYS)], fields[4 + len(_KEYS) :]
    summed = local.groupBy("bin").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows"), F.max("largest").alias("largest"), *(F.min(c).alias(c) for c in low), *(F.max(c).alias(c) for c in high))
    # A row per interval at most, whatever the table holds.
    return {
        r["bin"] - 1: Interval(bounds[r["bin"] - 1], r["size"], r["rows"], r["largest"], tuple(r[c] for c in low), tuple(r[c] for c in high))
        for r in summed.collect()
    }


def _even(low: int, high: int, parts: int) -> list[int]:
    """At most ``parts`` - 1 numbers above ``low`` and up to ``high`` that part the range evenly."""
    return sorted({low + (high - low + 1) * k // parts for k in range(1, parts)} - {low})


def candidates(interval: Interval) -> list[Key]:
    """New boundaries inside an interval, in the first part of its keys that varies."""
    for k in range(len(_KEYS)):
        if interval.least[k] != interval.most[k]:
            head = interval.least[:k]
            probes = [(*head, x, 0, 0)[: len(_KEYS)] for x in _even(interval.least[k], interval.most[k], FAN)]
            return [p for p in probes if p > interval.low]
    return []


def _at_border(bound: Key) -> bool:
    """Whether a boundary lies between texts."""
    return bound[1:] == (0, 0)


def cuts(intervals: list[Interval], shards: int, tolerance: float) -> tuple[list[int], set[int]]:
    """(cuts, unsettled): for each inner border of shards the interval that starts the next shard, and intervals to refine.

    A border's interval is the one whose start is nearest to its share of the bytes; a start between texts goes first, within
    the tolerance or, where no other text is left to try, within half the largest row.
    """
    starts = np.concatenate(([0], np.cumsum([i.size for i in intervals])))
    total = int(starts[-1])
    slack = tolerance * total / shards
    largest = max((i.largest for i in intervals), default=0)
    between_texts = np.flatnonzero([k == len(intervals) or _at_border(intervals[k].low) for k in range(len(starts))])
    anywhere = np.arange(len(starts))

    def nearest(places: np.ndarray, target: float) -> tuple[int, float]:
        k = int(np.searchsorted(starts[places], target))
        near = places[max(0, k - 1) : k + 1]
        best = int(near[np.argmin(np.abs(starts[near] - target))])
        return best, abs(starts[best] - target)

    chosen, unsettled = [], set()
    for target in (total * k / shards for k in range(1, shards)):
        cut, miss = nearest(between_texts, target)
        inside = min(int(np.searchsorted(starts, target, side="right")) - 1, len(intervals) - 1)
        if miss > slack and not intervals[inside].one_text:
            unsettled.add(inside)
        elif miss > max(slack, largest / 2):
            cut, miss = nearest(anywhere, target)
            if miss > slack and not intervals[inside].whole:
                unsettled.add(inside)
        chosen.append(cut)
    return sorted(chosen), unsettled


def histogram(keys: DataFrame, shards: int, tolerance: float) -> tuple[list[Interval], list[int], int]:
    """(intervals, cuts, rows of a piece): counts that settle every cut and leave no interval too large that can be parted."""
    bounds = [_LOWEST, *((x, 0, 0) for x in _even(0, _TOP, CELLS))]
    found = count_between(keys, bounds, [True] * len(bounds))
    intervals = [found[k] for k in sorted(found)]
    limit = min(PIECE_ROWS, max(64, sum(i.rows for i in intervals) // PIECES))
    while True:
        chosen, again = cuts(intervals, shards, tolerance)
        again |= {k for k, i in enumerate(intervals) if i.rows > limit and not i.whole}
        if not again:
            return intervals, chosen, limit
        bounds, wanted = [], []
        for k, interval in enumerate(intervals):
            inner = candidates(interval) if k in again else []
            bounds += [interval.low, *inner]
            wanted += [k in again] * (1 + len(inner))
        found = count_between(keys, bounds, wanted)
        kept = {i.low: i for k, i in enumerate(intervals) if k not in again}
        intervals = [found[k] if w else kept[b] for k, (b, w) in enumerate(zip(bounds, wanted)) if not w or k in found]


def pieces(intervals: list[Interval], chosen: list[int], limit: int) -> tuple[list[Key], list[int], list[int]]:
    """(bounds, shards, slots): where each piece starts, the shard it is in, and how many rows of the shard lie before it."""
    bounds, shards, slots = [], [], []
    shard, cut, rows, held = 0, 0, 0, 0
    for k, interval in enumerate(intervals):
        moved = False
        while cut < len(chosen) and chosen[cut] <= k:
            shard, cut, moved = shard + 1, cut + 1, True
        if moved:
            rows = 0
        if not bounds or moved or held + interval.rows > limit:
            bounds.append(interval.low)
            shards.append(shard)
            slots.append(rows)
            held = 0
        rows += interval.rows
        held += interval.rows
    return bounds, shards, slots


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, carry: list[Column] | None = None, size: Column | None = None) -> DataFrame:
    """``docs`` (doc_id, text, ...) as the carried columns (all of them, unless given), size, shard and slot.

    Slots of a shard are 0, 1, 2, ... in the order of keys.
    """
    carried = [docs[f"`{c}`"] for c in docs.columns if c.lower() not in ("size", "shard", "slot")] if carry is None else carry
    keys = keyed(docs, carried, text_size() if size is None else size)
    intervals, chosen, limit = histogram(keys, shards, tolerance)
    bounds, of_shard, of_slot = pieces(intervals, chosen, limit)
    columns = _columns(bounds)

    @F.arrow_udf("int")
    def piece(text: pa.Array, row_id: pa.Array, row: pa.Array) -> pa.Array:
        return pa.array((place([x.to_numpy(zero_copy_only=False) for x in (text, row_id, row)], columns) - 1).astype(np.int32))

    starts = docs.sparkSession.createDataFrame(list(zip(range(len(bounds)), of_shard, of_slot)), "shard_piece int, shard int, first_slot long")
    order = Window.partitionBy("shard_piece").orderBy(*_KEYS)
    ranked = keys.withColumn("shard_piece", piece(*_KEYS)).withColumn("rank", F.row_number().over(order))
    return ranked.join(F.broadcast(starts), "shard_piece", "left").select("row.*", "size", "shard", (F.col("first_slot") + F.col("rank") - 1).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, tolerance: float = TOLERANCE) -> None:
    """``docs`` as Parquet under ``path``, a folder per shard; a shard's pieces are its files."""
    shard(docs, shards, tolerance).write.partitionBy("shard").parquet(path)
