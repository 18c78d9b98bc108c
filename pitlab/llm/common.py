"""Helpers of the operators: UTF-8 columns as numpy arrays, hashed words, row keys and stored tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlab.session import materialize

#: Bytes of text that are turned into numpy arrays at once. A longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 19

#: Rows of ids and flags that may be broadcast: some 80 MB in a task's memory.
BROADCAST_ROWS = 1 << 21

_U64 = np.uint64
_RATIO = 0x9E3779B97F4A7C15 | 1
_RATIO_INVERSE = pow(_RATIO, -1, 1 << 64)
_powers: list[np.ndarray] = []

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE_CODES = np.random.Generator(np.random.PCG64(20250101)).integers(0, 1 << 64, 256, dtype=_U64)


def give_back() -> None:
    """Hands memory that this worker no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, and at its end ``give_back``: a worker lives on through later stages, beside a JVM that needs the memory."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def checked(keys: DataFrame) -> DataFrame:
    """``keys``, a table of an id and at most a flag, written once; for broadcast if its count is within the bound.

    Beyond the bound the same join shuffles both sides.
    """
    small = materialize(keys, "keys")
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the row offsets into them. Null is an empty text."""
    column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, data = column.buffers()
    if len(column) == 0 or places is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(places, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, or of one row."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, high
        low = high


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a hash depends on all of its input."""
    values = (values ^ (values >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> _U64(27))) * _U64(0x94D049BB133111EB)
    return values ^ (values >> _U64(31))


def _powers_to(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the ratio and of its inverse modulo 2**64. Kept for ordinary chunks only."""
    if not _powers or len(_powers[0]) < size:
        made = []
        for ratio in (_RATIO, _RATIO_INVERSE):
            steps = np.full(max(size, CHUNK_BYTES + 1), ratio, dtype=_U64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        if size > CHUNK_BYTES + 1:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``codes`` (uint64): the same content has the same hash anywhere."""
    power, inverse = _powers_to(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=_U64)
    np.cumsum(codes * power[: len(codes)], out=sums[1:])
    values = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(values + (ends - starts).astype(_U64) * _U64(0xD6E8FEB86659FD93))


def word_table(separators: list[tuple[int, int]]) -> np.ndarray:
    """Which bytes belong to words, given the inclusive ranges of ASCII that part them."""
    table = np.ones(256, dtype=bool)
    for low, high in separators:
        table[low : high + 1] = False
    return table


def words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words, and the index of each row's first word (one more at the end)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[raw]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(raw)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): a hash of each word with A-Z lower-cased, and the index of each row's first word."""
    starts, ends, first = words(raw, offsets, table)
    return span_hashes(_BYTE_CODES[LOWER[raw]], starts, ends), first


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every range, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total, dtype=np.int64) + shift
