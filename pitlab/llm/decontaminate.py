"""Benchmark decontamination with an FM-index per shard.

A shard is a run of documents within a task. Its words become symbols of the benchmark's vocabulary; stretches without
any phrase-length run of such words cannot hold a phrase and are one separator in the indexed text. Over that text stands an
FM-index: Burrows-Wheeler transform, ranks in a wavelet matrix, and suffix positions kept for every
``SAMPLE_STEP``-th symbol. All test phrases are searched backwards together, their occurrences are located by walking
to the next kept position, and overlapping occurrences are merged into removal spans.

Words are maximal runs of ASCII letters and digits and of all non-ASCII characters, with A-Z lower-cased. A
phrase is each window of 13 consecutive words of an item; an item of fewer words, but not none, is one phrase.

The benchmark travels to the tasks in blocks of at most ``BLOCK_BYTES`` of text and one item more, one pass per block. Blocks are
cut in Spark by a running sum over the items and written; the driver takes one at a time, and the result of each pass but the
last is written, so that neither the driver nor a task ever holds more than one block's phrases.

Null or empty document: no words, no hit, not contaminated. Items with a null id or without words are never found; an id
that occurs twice is one item with the phrases of both texts. Repeated documents give repeated rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlab.llm.common import CHUNK_BYTES, chunks, ragged, tidy, utf8, word_hashes, word_table
from pitlab.operators.scan import blocked_sum, in_blocks
from pitlab.session import materialize

WINDOW_WORDS = 13
SAMPLE_STEP = 8
SHARD_BYTES = CHUNK_BYTES
BLOCK_BYTES = 1 << 24
#: ASCII that parts words: all but digits and letters.
WORDS = word_table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
_SEPARATOR = 1  # 0 ends the text


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix positions in order, by prefix doubling. The last symbol is the only 0."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step if step < n else 0] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.zeros(n, np.int64)
        fresh[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = fresh
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    """Ranks of symbols: one bit vector per bit of a symbol, each with counts by machine word."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.words, self.counts, self.zeros = bits, [], [], []
        now = symbols
        for level in range(bits - 1, -1, -1):
            bit = (now >> level & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate((bit, np.zeros(64 - len(bit) % 64, np.uint8))), bitorder="little").view(np.uint64)
            before = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=before[1:])
            self.words.append(packed)
            self.counts.append(before)
            self.zeros.append(len(bit) - int(bit.sum()))
            now = np.concatenate((now[bit == 0], now[bit == 1]))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word, inner = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << inner) - np.uint64(1)
        return self.counts[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        start, end = np.zeros_like(at), at
        for level in range(self.bits):
            one = symbols >> (self.bits - 1 - level) & 1 == 1
            ones_start, ones_end = self._ones(level, start), self._ones(level, end)
            start = np.where(one, self.zeros[level] + ones_start, start - ones_start)
            end = np.where(one, self.zeros[level] + ones_end, end - ones_end)
        return end - start


class FmIndex:
    """Backward search over a text of small whole numbers, none of them 0."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        closed = np.append(text, 0)
        order = suffix_array(closed)
        self.last = closed[order - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(closed, minlength=symbols))))
        self.matrix = WaveletMatrix(self.last, max(1, int(symbols - 1).bit_length()))
        kept = order % SAMPLE_STEP == 0
        self.kept = np.concatenate(([0], np.cumsum(kept)))
        self.positions = order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range of each row of ``phrases``; empty if low >= high."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.last), np.int64)
        alive = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, k]
            base = self.first[symbol]
            low[alive] = base + self.matrix.rank(symbol, low[alive])
            high[alive] = base + self.matrix.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        gone = np.ones(len(phrases), bool)
        gone[alive] = False
        high[gone] = low[gone]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, walking back to a kept position."""
        result, steps, left = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        now = rows.copy()
        while len(left):
            known = self.kept[now + 1] > self.kept[now]
            result[left[known]] = self.positions[self.kept[now[known]]] + steps
            left, now = left[~known], now[~known]
            symbol = self.last[now]
            now = self.first[symbol] + self.matrix.rank(symbol, now)
            steps += 1
        return result


@dataclass(frozen=True)
class Group:
    """Distinct phrases of one length, and the items of each: those of phrase k are ``items[edges[k] : edges[k + 1]]``."""

    phrases: np.ndarray
    edges: np.ndarray
    items: np.ndarray


@dataclass(frozen=True)
class Phrases:
    """The phrases of a block of items, as symbols of the block's vocabulary."""

    vocabulary: np.ndarray  # sorted word hashes; symbol k + 2 stands for entry k
    names: list[str]  # item ids, sorted; items are numbers of it
    groups: list[Group]

    @property
    def shortest(self) -> int:
        return min((g.phrases.shape[1] for g in self.groups), default=0)


def _group(symbols: np.ndarray, starts: np.ndarray, owners: np.ndarray, size: int, n_items: int) -> Group:
    """The windows of ``size`` symbols at ``starts``, each once."""
    windows = np.ascontiguousarray(symbols[starts[:, None] + np.arange(size)])
    _, first, which = np.unique(windows.view(np.dtype((np.void, windows.itemsize * size))).ravel(), return_index=True, return_inverse=True)
    pairs = np.unique(which * n_items + owners)
    return Group(windows[first], np.searchsorted(pairs // n_items, np.arange(len(first) + 1)), pairs % n_items)


def phrases_of(items: list[tuple[str, str]], window: int = WINDOW_WORDS) -> Phrases:
    """The phrases of (item id, text) pairs."""
    names = sorted({item for item, _ in items})
    number = {name: k for k, name in enumerate(names)}
    hashes, first = word_hashes(*utf8(pa.array([t for _, t in items], pa.string())), WORDS)
    vocabulary = np.unique(hashes)
    symbols = (np.searchsorted(vocabulary, hashes) + 2).astype(np.int32)
    owners, sizes = np.array([number[item] for item, _ in items], np.int64), np.minimum(np.diff(first), window)
    groups = []
    for size in np.unique(sizes[sizes > 0]).tolist():
        own = sizes == size
        counts = np.diff(first)[own] - size + 1
        groups.append(_group(symbols, ragged(first[:-1][own], counts), np.repeat(owners[own], counts), size, len(names)))
    return Phrases(vocabulary, names, groups)


def _runs(inside: np.ndarray, row_of: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of runs of words inside the vocabulary, within a row, of at least ``shortest``."""
    head = inside.copy()
    head[1:] &= ~(inside[:-1] & (row_of[1:] == row_of[:-1]))
    tail = inside.copy()
    tail[:-1] &= ~(inside[1:] & (row_of[1:] == row_of[:-1]))
    start = np.flatnonzero(head)
    length = np.flatnonzero(tail) + 1 - start
    long = length >= shortest
    return start[long], length[long]


def search_shard(raw: np.ndarray, offsets: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, str]]]:
    """(words, starts, ends, found): word counts of the rows, merged spans over the shard's words, and (row, item) pairs."""
    hashes, first = word_hashes(raw, offsets, WORDS)
    counts = np.diff(first)
    none = np.zeros(0, np.int64)
    if not len(hashes) or not len(phrases.vocabulary):
        return counts, none, none, []
    at = np.minimum(np.searchsorted(phrases.vocabulary, hashes), len(phrases.vocabulary) - 1)
    row_of = np.repeat(np.arange(len(counts)), counts)
    start, length = _runs(phrases.vocabulary[at] == hashes, row_of, phrases.shortest)
    if not len(start):
        return counts, none, none, []
    places = np.insert(ragged(start, length), np.cumsum(length)[:-1], -1)  # a separator between runs
    index = FmIndex(np.where(places < 0, _SEPARATOR, at[places] + 2), len(phrases.vocabulary) + 2)
    begins, ends, found = [], [], [np.zeros((2, 0), np.int64)]
    for group in phrases.groups:
        low, high = index.search(group.phrases)
        which = np.repeat(np.arange(len(low)), high - low)
        if not len(which):
            continue
        place = places[index.locate(ragged(low, high - low))]
        begins.append(place)
        ends.append(place + group.phrases.shape[1])
        row, phrase = np.unique(np.stack([row_of[place], which]), axis=1)
        counts_of = np.diff(group.edges)[phrase]
        found.append(np.stack([np.repeat(row, counts_of), group.items[ragged(group.edges[phrase], counts_of)]]))
    if not begins:
        return counts, none, none, []
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, np.concatenate(begins), 1)
    np.add.at(change, np.concatenate(ends), -1)
    row_edges = first[1:-1]
    covered = np.cumsum(change[:-1]) > 0
    before = np.concatenate(([False], covered[:-1]))
    before[row_edges[row_edges < len(covered)]] = False
    after = np.concatenate((covered[1:], [False]))
    after[row_edges[row_edges > 0] - 1] = False
    return counts, np.flatnonzero(covered & ~before), np.flatnonzero(covered & ~after) + 1, [(r, phrases.names[i]) for r, i in np.unique(np.concatenate(found, axis=1), axis=1).T.tolist()]


def _blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[tuple[list[tuple[str, str]], bool]]:
    """Blocks of (item id, text), and whether it is the last."""
    rows = benchmark.select(F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    if (rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0) <= BLOCK_BYTES:
        yield [tuple(r) for r in rows.collect()], True
        return
    # Items by their last byte in the order of all: a block is BLOCK_BYTES of that order.
    summed = blocked_sum(in_blocks(rows, [], ["k", "t"], "benchmark"), [], F.octet_length("t").cast("long"), "end")
    stored = materialize(summed.select("k", "t", F.expr(f"greatest(end - 1, 0) div {BLOCK_BYTES}").alias("block")), "benchmark-blocks")
    numbers = [n for (n,) in stored.select("block").distinct().orderBy("block").collect()]
    for n in numbers:
        yield [tuple(r) for r in stored.where(F.col("block") == n).select("k", "t").collect()], n == numbers[-1]


def find_spans(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per document: n_words, merged spans (first word, word after the last) and ids of items, as strings.

    Columns named in ``carry`` go along; ``text`` among them is the text that was searched.
    """
    carry = carry or []
    texts = [c for c in carry if c == "text"]
    carry = [c for c in carry if c != "text"]
    found = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *carry)
    found = found.selectExpr(*carry, "doc_id", "text", "0L AS n_words", "CAST(array() AS array<bigint>) AS starts", "CAST(array() AS array<bigint>) AS ends", "CAST(array() AS array<string>) AS items")
    for block, last in _blocks(benchmark, item_key, item_text):
        found = _pass(found, phrases_of(block))
        if not last:
            found = materialize(found, "benchmark-pass")
    return found if texts else found.drop("text")


def _pass(found: DataFrame, phrases: Phrases) -> DataFrame:
    """Adds what one block of the benchmark finds."""
    shared = found.sparkSession.sparkContext.broadcast(phrases)  # of one block of the benchmark
    names = found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            for low, high in chunks(offsets, SHARD_BYTES):
                part = batch.slice(low, high - low)
                counts, starts, ends, pairs = search_shard(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], shared.value)
                columns = [part.column(c).to_pylist() if len(pairs) else part.column(c) for c in ("starts", "ends", "items")]
                if pairs:
                    first = np.concatenate(([0], np.cumsum(counts)))
                    rows = np.searchsorted(first, starts, side="right") - 1
                    for row in sorted({r for r, _ in pairs}):
                        own = rows == row
                        spans = merged([*zip(columns[0][row], columns[1][row], strict=True), *zip((starts[own] - first[row]).tolist(), (ends[own] - first[row]).tolist(), strict=True)])
                        columns[0][row], columns[1][row] = [a for a, _ in spans], [b for _, b in spans]
                        columns[2][row] = sorted({*columns[2][row], *(i for r, i in pairs if r == row)})
                    columns = [pa.array(c, pa.list_(t)) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)]
                held = [part.column(c) for c in names[:-4]]
                yield pa.RecordBatch.from_arrays([*held, pa.array(counts), *columns], names=names)

    return found.mapInArrow(tidy(run), found.schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch, as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(found: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The verdict of each document: hit words, items, and whether hit words are at least a twentieth of all."""
    carry = carry or []
    hit = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("long"), lambda total, s: total + s["ends"] - s["starts"])
    rows = found.select(*carry, "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), F.transform(F.arrays_zip("starts", "ends"), lambda s: F.concat_ws(":", s["starts"], s["ends"])).alias("spans"))
    return rows.select(*carry, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", F.expr("n_hit > 0 AND 20 * n_hit >= n_words").alias("contaminated"), F.array_join("spans", ",").alias("removal_spans"))
