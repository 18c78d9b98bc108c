"""Lexical retrieval packing.

Documents are tokenised and closed with an end id. A task cuts its share of the input into shards of about
``SHARD_TOKENS`` tokens (whole windows of a long document become sequences at once; only its rest joins the shard).
Each shard has a BM25 inverted index over token ids. A seed document opens a window; its best unused neighbours by BM25
fill it greedily, whole while they fit, and the next one is cut so that the window is full. The cut rest is the next
seed. What a shard leaves open is carried into the next one, so a task pads one sequence at most. No shuffle takes place.

``sequence_id`` is unique over the table: the task's number and a running number. Every id of every document lies in
exactly one piece; a sequence's offsets have no gap.

A null text is empty: its document is the end id alone. Repeated rows are packed one by one. An empty table gives no
piece. Texts of any length are tokenised whole. Other columns are ignored.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlab.llm.bytepairs import classes, code_points, pieces
from pitlab.llm.common import chunks, ragged, span_hashes, tidy, utf8

WINDOW, END_ID = 2048, 1
SHARD_TOKENS = 1 << 19
K1, B = 1.2, 0.75
KNOWN_WORDS = 1 << 19
#: New words that the library encodes as one text.
WORDS_AT_ONCE = 1 << 8


@lru_cache(maxsize=1)
def _lowering() -> tuple[np.ndarray, np.ndarray]:
    """(lower case of each code point, whether it may be lower-cased on its own without changing its class)."""
    lower, plain, kinds = np.arange(0x110000, dtype=np.uint32), np.ones(0x110000, bool), classes()
    plain[0xD800:0xE000] = False
    for code in range(0x110000):
        small = chr(code).lower()
        if len(small) != 1 or small != chr(code):
            if len(small) == 1 and kinds[ord(small)] == kinds[code]:
                lower[code] = ord(small)
            else:
                plain[code] = False
    return lower, plain


class WordTokens:
    """Ids by a word-level vocabulary file, each distinct piece encoded once while the table of known pieces holds it.

    Texts with special strings, or that normalisation or lower case would reshape, go to the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        mark = getattr(self.library.model, "end_of_word_suffix", None)
        self.closes: np.ndarray | None = None
        if mark:
            vocabulary = self.library.get_vocab()
            self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
            self.closes[[k for token, k in vocabulary.items() if token.endswith(mark)]] = True
        self.forget()

    def forget(self) -> None:
        self.keys, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each row."""
        text = raw.tobytes().decode()
        lower, plain = _lowering()
        codes, places = code_points(raw, offsets)
        small = lower[codes]
        ordinary = bool(plain[codes].all()) and not any(s in text for s in self.specials) and (text.isascii() or unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", small.tobytes().decode("utf-32-le")))
        if not ordinary:
            if len(offsets) == 2:
                return [self.whole(text)]
            return [self.encode(raw[a:b], np.array([0, b - a]))[0] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        starts, ends = pieces(small, places, prefix_space=False, single_numbers=True, keep_space=False)
        keys = span_hashes(small.astype(np.uint64) + np.uint64(1), starts, ends)
        distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
        at = self._places(distinct, small, starts[first], ends[first])
        begin, size = self.starts[at][which], self.sizes[at][which]
        flat = self.ids[ragged(begin, size)]
        total = np.concatenate(([0], np.cumsum(size)))
        edges = total[np.searchsorted(starts, places)]
        return [flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def _places(self, distinct: np.ndarray, small: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where each distinct key stands among the known ones, after adding those that are new."""
        if len(self.keys) + len(distinct) > max(KNOWN_WORDS, 2 * len(distinct)):
            self.forget()
        at = np.searchsorted(self.keys, distinct)
        is_new = self.keys[np.minimum(at, len(self.keys) - 1)] != distinct if len(self.keys) else np.ones(len(distinct), bool)
        new = np.flatnonzero(is_new)
        if len(new):
            made, sizes = self._ids_of(small, starts[new], ends[new])
            begins = len(self.ids) + np.concatenate(([0], np.cumsum(sizes)[:-1]))
            self.ids = np.concatenate((self.ids, made))
            self.keys, self.starts, self.sizes = (np.insert(a, at[new], b) for a, b in ((self.keys, distinct[new]), (self.starts, begins), (self.sizes, sizes)))
            at += np.cumsum(is_new) - is_new
        return at

    def _ids_of(self, small: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces, one piece after the other; their number per piece).

        Pieces hold no white space, so the library parts a row of them, with spaces between, as they are. Where a piece ends
        is told by its last id, which alone carries the vocabulary's end mark; without one, pieces are encoded one by one.
        """
        encode = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        closing = np.cumsum(ends - starts + 1) - 1
        spaced = small[np.minimum(ragged(starts, ends - starts + 1), len(small) - 1)]
        spaced[closing] = 0x20
        if self.closes is not None:
            line = spaced.tobytes().decode("utf-32-le")
            cuts = [0, *(closing[WORDS_AT_ONCE - 1 : -1 : WORDS_AT_ONCE] + 1).tolist(), len(line)]
            made = [np.array(e.ids, np.uint32) for e in encode([line[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], add_special_tokens=False)]
            flat = np.concatenate(made)
            last = np.flatnonzero(self.closes[flat])
            if len(last) == len(starts) and last[-1] == len(flat) - 1:
                return flat, np.diff(last, prepend=-1)
        each = [e.ids for e in encode([small[a:b].tobytes().decode("utf-32-le") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(each), np.uint32), np.array([len(x) for x in each], np.int64)


class Bm25Index:
    """Postings by token over the documents of a shard; a token in half of them or more has no weight."""

    def __init__(self, documents: list[np.ndarray]) -> None:
        lengths = np.array([len(d) for d in documents], np.int64)
        owner = np.repeat(np.arange(len(documents)), lengths)
        keys, counts = np.unique(np.concatenate(documents).astype(np.int64) * len(documents) + owner if documents else np.zeros(0, np.int64), return_counts=True)
        token, self.doc = keys // max(len(documents), 1), keys % max(len(documents), 1)
        heads = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, np.int64)
        self.tokens, self.begin = token[heads], heads
        self.size = np.diff(np.append(heads, len(token)))
        n = len(documents)
        idf = np.maximum(np.log((n - self.size + 0.5) / (self.size + 0.5)), 0.0)
        norm = K1 * (1 - B + B * lengths / max(lengths.mean(), 1.0)) if n else lengths
        self.weight = np.repeat(idf, self.size) * counts * (K1 + 1) / (counts + norm[self.doc])
        self.useful = idf > 0
        self.n = n

    def scores(self, document: np.ndarray) -> np.ndarray:
        """BM25 of every document of the shard for the distinct tokens of ``document``."""
        query = np.unique(document).astype(np.int64)
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        at = at[(self.tokens[at] == query) & self.useful[at]]
        where = ragged(self.begin[at], self.size[at])
        return np.bincount(self.doc[where], weights=self.weight[where], minlength=self.n)


@dataclass
class _Piece:
    doc_id: int | None
    start: int
    ids: np.ndarray
    total: int


@dataclass
class Packer:
    """Fills windows shard by shard and hands out the rows of finished pieces."""

    window: int = WINDOW
    shard_tokens: int = SHARD_TOKENS
    first_sequence: int = 0
    waiting: list[_Piece] = field(default_factory=list)
    held: int = 0
    open: list[_Piece] = field(default_factory=list)
    used: int = 0
    sequences: int = 0
    rows: list[tuple] = field(default_factory=list)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """A document; its whole windows are sequences of their own."""
        whole = len(ids) // self.window * self.window
        for start in range(0, whole, self.window):
            self._close([_Piece(doc_id, start, ids[start : start + self.window], len(ids))])
        if whole < len(ids):
            self.waiting.append(_Piece(doc_id, whole, ids[whole:], len(ids)))
            self.held += len(ids) - whole
            if self.held >= self.shard_tokens:
                self.pack()

    def _close(self, pieces_: list[_Piece]) -> None:
        sequence, offset = self.first_sequence + self.sequences, 0
        for p in pieces_:
            self.rows.append((p.doc_id, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.total, sequence, offset))
            offset += len(p.ids)
        self.sequences += 1

    def _put(self, piece: _Piece) -> _Piece | None:
        """Adds what fits to the open window; the rest, if any."""
        room = self.window - self.used
        head, tail = piece.ids[:room], piece.ids[room:]
        self.open.append(_Piece(piece.doc_id, piece.start, head, piece.total))
        self.used += len(head)
        if self.used == self.window:
            self._close(self.open)
            self.open, self.used = [], 0
        return _Piece(piece.doc_id, piece.start + room, tail, piece.total) if len(tail) else None

    def pack(self) -> None:
        """Packs the shard. Its last window stays open."""
        shard, self.waiting, self.held = self.waiting, [], 0
        index = Bm25Index([p.ids for p in shard])
        unused = np.ones(len(shard), bool)
        sizes = np.array([len(p.ids) for p in shard], np.int64)
        rest: _Piece | None = None
        queue = deque(range(len(shard)))
        while True:
            if rest is not None:
                seed, rest = rest, None
            else:
                while queue and not unused[queue[0]]:
                    queue.popleft()
                if not queue:
                    return
                seed = shard[queue[0]]
                unused[queue.popleft()] = False
            left = self._put(seed)
            if left is not None or self.used == 0:
                rest = left
                continue
            scores = index.scores(seed.ids)
            free = np.flatnonzero(unused)
            order = free[np.argsort(-scores[free], kind="stable")]
            # Whole neighbours while they fit, best first; then the best one left is cut.
            while len(order) and self.used:
                fitting = np.flatnonzero(sizes[order] <= self.window - self.used)
                pick = int(fitting[0]) if len(fitting) else 0
                unused[order[pick]] = False
                rest = self._put(shard[order[pick]])
                order = np.delete(order, pick)

    def finish(self) -> None:
        self.pack()
        if self.open:
            self._close(self.open)
            self.open, self.used = [], 0


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=2)
def _loaded(path: str) -> WordTokens:
    return WordTokens(path)


def pack(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece. ``path`` is the vocabulary file, the same on every executor."""

    def rows(packer: Packer) -> pa.RecordBatch:
        columns = list(zip(*packer.rows, strict=True)) or [[]] * 7
        packer.rows = []
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=[x.split()[0] for x in PIECES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _loaded(path)
        packer = Packer(window, shard_tokens, TaskContext.get().partitionId() << 40)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            raw, offsets = utf8(batch.column("text"))
            for low, high in chunks(offsets):
                for k, found in enumerate(tokens.encode(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])):
                    packer.add(ids[low + k], np.append(found, np.uint32(end_id)))
                if len(packer.rows) >= 4096:
                    yield rows(packer)
        packer.finish()
        _loaded.cache_clear()  # a worker may go on with other stages: the known words go with the task
        yield rows(packer)

    return documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), PIECES)
