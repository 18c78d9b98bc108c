"""Token counts by byte-pair merging on a heap and a linked list.

A text is parted into pieces as the vocabulary's pattern does. Every distinct piece starts as one symbol per byte; the
lowest-ranked adjacent pair is popped and merged until no pair has a rank. The count is bytes minus merges: no
identifier is made. Special strings of the vocabulary count one token each, as its library does by default.

Pieces are found in numpy and looked up by a 64-bit hash, so a piece is merged once per worker as long as the table of
known pieces (``KNOWN_PIECES`` entries of 12 bytes) holds it.

A null text is empty: 0 bytes, 0 tokens. Texts of any length are counted whole. Repeated rows give repeated rows.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlab.llm.common import CHUNK_BYTES, chunks, span_hashes, utf8

KNOWN_PIECES = 1 << 21

# The pattern of the vocabulary, and the code points of White_Space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """OTHER, LETTER, NUMBER or SPACE of every code point."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            table[code] = LETTER
        elif kind == "N":
            table[code] = NUMBER
    table[WHITE_SPACE] = SPACE
    return table


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the row offsets among them."""
    codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(codes) == len(raw):
        return codes, offsets
    counted = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=counted[1:])
    return codes, counted[offsets]


def pieces(codes: np.ndarray, offsets: np.ndarray, prefix_space: bool = True, single_numbers: bool = False, keep_space: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the pieces of all rows, in order, as ``PATTERN`` finds them in each row.

    The flags cover its relatives: no space before a piece, one piece per number character, white space dropped.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[codes]
    row_start = np.zeros(n + 1, dtype=bool)
    row_start[offsets] = True
    begins = row_start.copy()
    begins[1:n] |= kind[1:] != kind[:-1]
    if single_numbers:
        begins[:n] |= kind == NUMBER

    # An apostrophe that opens a piece takes the letters of a contraction.
    quote = np.flatnonzero((codes == ord("'")) & begins[:n])
    if len(quote):
        behind = kind[np.maximum(quote - 1, 0)]
        if prefix_space:
            spaced = (quote > 0) & ~row_start[quote] & (codes[np.maximum(quote - 1, 0)] == 0x20) & (behind == SPACE)
            quote = quote[~spaced]
        end_of_row = offsets[np.searchsorted(offsets, quote, side="right")]
        first = np.where(quote + 1 < end_of_row, codes[np.minimum(quote + 1, n - 1)], 0)
        second = np.where(quote + 2 < end_of_row, codes[np.minimum(quote + 2, n - 1)], 0)
        one = np.isin(first, [ord(c) for c in "stmd"])
        two = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
        size = np.where(two, 3, np.where(one, 2, 0))
        quote, size = quote[size > 0], size[size > 0]
        begins[quote + 1] = False
        begins[np.minimum(quote + size, n)] = True

    if prefix_space:
        # The last white space before a piece: a plain space joins the piece, any other stands alone.
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~row_start[1:n])
        begins[last] = True
        joined = last[codes[last] == 0x20]
        begins[joined + 1] = False
    begins[n] = True
    edges = np.flatnonzero(begins)
    starts, ends = edges[:-1], edges[1:]
    if not keep_space:
        kept = kind[starts] != SPACE
        starts, ends = starts[kept], ends[kept]
    return starts, ends


class Merges:
    """Ranks of a byte-level vocabulary file and the count of any piece."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        alphabet = byte_letters()
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        symbols = {alphabet[b]: b for b in range(256)}
        for rank, pair in enumerate(held["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            new = symbols.setdefault(left + right, len(symbols))
            self.ranks.setdefault((symbols[left], symbols[right]), rank)
            self.made.append(new)
        self.specials = [x["content"] for x in held.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None

    def count(self, piece: bytes) -> int:
        """Tokens of one piece: its bytes minus the merges done."""
        n = len(piece)
        if n < 2:
            return n
        ranks, made = self.ranks, self.made
        symbol = list(piece)
        heap = [(rank, i, i + 1, symbol[i], symbol[i + 1]) for i in range(n - 1) if (rank := ranks.get((symbol[i], symbol[i + 1]))) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        count = n
        while heap:
            rank, left, right, was_left, was_right = heapq.heappop(heap)
            if symbol[left] != was_left or after[left] != right or symbol[right] != was_right:
                continue  # one of the two was merged meanwhile
            count -= 1
            merged = symbol[left] = made[rank]
            symbol[right] = -1
            follow = after[left] = after[right]
            if follow < n:
                before[follow] = left
                if (rank := ranks.get((merged, symbol[follow]))) is not None:
                    heapq.heappush(heap, (rank, left, follow, merged, symbol[follow]))
            if (previous := before[left]) >= 0 and (rank := ranks.get((symbol[previous], merged))) is not None:
                heapq.heappush(heap, (rank, previous, left, symbol[previous], merged))
        return count


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabulary files: itself, or the next from U+0100."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = [], 0x100
    for byte in range(256):
        if byte in shown:
            letters.append(chr(byte))
        else:
            letters.append(chr(spare))
            spare += 1
    return letters


class KnownPieces:
    """Values of pieces by hash: sorted arrays of bounded size, emptied when they are full."""

    def __init__(self, limit: int = KNOWN_PIECES) -> None:
        self.limit = limit
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, known) of distinct keys."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int32), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.values[at], self.keys[at] == keys

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add sorted new keys."""
        if len(self.keys) + len(keys) > self.limit:
            self.keys, self.values = keys[: self.limit], values[: self.limit].astype(np.int32)
            return
        at = np.searchsorted(self.keys, keys)
        self.keys, self.values = np.insert(self.keys, at, keys), np.insert(self.values, at, values)


@lru_cache(maxsize=2)
def _loaded(path: str) -> tuple[Merges, KnownPieces]:
    return Merges(path), KnownPieces()


def count_texts(raw: np.ndarray, offsets: np.ndarray, merges: Merges, known: KnownPieces) -> np.ndarray:
    """Tokens of each row, without special strings."""
    codes, places = code_points(raw, offsets)
    starts, ends = pieces(codes, places)
    keys = span_hashes(codes.astype(np.uint64) + np.uint64(1), starts, ends)
    distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
    values, have = known.get(distinct)
    new = np.flatnonzero(~have)
    if len(new):
        values = values.copy()
        at = first[new]
        for k, low, high in zip(new.tolist(), starts[at].tolist(), ends[at].tolist(), strict=True):
            values[k] = merges.count(codes[low:high].tobytes().decode("utf-32-le").encode())
        known.put(distinct[new], values[new])
    total = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(values[which], out=total[1:])
    edges = np.searchsorted(starts, places)
    return total[edges[1:]] - total[edges[:-1]]


def count_column(column: pa.Array, merges: Merges, known: KnownPieces) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, tokens) of each row of a string column."""
    raw, offsets = utf8(column)
    sizes, tokens = np.diff(offsets), np.zeros(len(column), np.int64)
    for low, high in chunks(offsets, CHUNK_BYTES):
        begin, end = offsets[low], offsets[high]
        part = raw[begin:end]
        special = merges.special.search(part.tobytes().decode()) if merges.special else None
        if special is None:
            tokens[low:high] = count_texts(part, offsets[low : high + 1] - begin, merges, known)
            continue
        for row in range(low, high):
            text = raw[offsets[row] : offsets[row + 1]].tobytes().decode()
            plain = merges.special.split(text)
            data = [x.encode() for x in plain]
            cuts = np.concatenate(([0], np.cumsum([len(x) for x in data])))
            tokens[row] = int(count_texts(np.frombuffer(b"".join(data), np.uint8), cuts, merges, known).sum()) + len(plain) - 1
    return sizes, tokens


def count_tokens(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its key, n_bytes and n_tokens. ``path`` is the vocabulary file, the same on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, known = _loaded(path)
        for batch in batches:
            sizes, tokens = count_column(batch.column("text"), merges, known)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(tokens)], names=["doc_id", "n_bytes", "n_tokens"])

    return documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
