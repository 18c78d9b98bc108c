"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. The trigram ``abc`` binds them, permuted by place: rho(rho(a)) * rho(b) * c.
A text bundles (adds) the vectors of all its trigrams, a language those of all its training texts, and a text gets the
language whose prototype has the greatest cosine with it.

Letters are lower-cased code points of category L; a run of anything else is one border symbol. Code points from
``LATIN_LETTERS`` on share ``OTHER_LETTERS`` vectors by hash, so the letter table has a fixed size.

Prototypes are a written table. They go to tasks in blocks of ``BLOCK_LANGUAGES`` in code order, so any number of languages
can be learned; each block after the first is one more pass over the texts, which carries the best language so far.

Null text or text without a letter: language ``und``, score 0. Rows with a null language or no letter teach nothing. With
nothing to learn from, every text is ``und``. Cosines that are equal to twelve places go to the first language in code
order. Repeated rows are
scored one by one; they count as often as they occur in training. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlab.llm.bytepairs import LETTER, classes, code_points
from pitlab.llm.common import chunks, mix, utf8
from pitlab.session import materialize

DIMENSIONS = 1024
LATIN_LETTERS, OTHER_LETTERS = 768, 256
#: Languages that a pass compares with: 32 MB of prototypes.
BLOCK_LANGUAGES = 4096
UNDETERMINED = "und"
_SEED, _KNOWN, _SLICE, _TOGETHER = 4242, 1 << 14, 4096, 1 << 20
_BITS = 10


@lru_cache(maxsize=1)
def letter_index() -> np.ndarray:
    """The vector number of every code point; 0 is the border."""
    table = np.zeros(0x110000, dtype=np.int32)
    letters = np.flatnonzero(classes() == LETTER)
    lowered = letters.copy()
    for k, code in enumerate(letters.tolist()):
        small = chr(code).lower()
        if len(small) == 1:
            lowered[k] = ord(small)
    far = LATIN_LETTERS + (mix(lowered.astype(np.uint64)) % np.uint64(OTHER_LETTERS)).astype(np.int64)
    table[letters] = np.where(lowered < LATIN_LETTERS, lowered, far)
    return table


@lru_cache(maxsize=2)
def letter_vectors(dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters' vectors, permuted twice, once and not at all."""
    drawn = np.random.Generator(np.random.PCG64(_SEED)).integers(0, 2, (LATIN_LETTERS + OTHER_LETTERS, dimensions), dtype=np.int8)
    plain = (2 * drawn - 1).astype(np.int8)
    return np.roll(plain, 2, axis=1), np.roll(plain, 1, axis=1), plain


def bind(trigrams: np.ndarray, dimensions: int) -> np.ndarray:
    """The vectors of trigram numbers, one row each."""
    first, second, third = letter_vectors(dimensions)
    mask = (1 << _BITS) - 1
    return first[trigrams >> 2 * _BITS] * second[trigrams >> _BITS & mask] * third[trigrams & mask]


class _Bound:
    """Vectors of trigrams seen so far, up to a fixed number."""

    def __init__(self, dimensions: int) -> None:
        self.dimensions = dimensions
        self.keys, self.places = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.vectors = np.zeros((_KNOWN, dimensions), np.float32)
        self.used = 0

    def bundle(self, trigrams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the vectors of distinct sorted trigrams, times their counts."""
        total = np.zeros(self.dimensions, np.float64)
        for low in range(0, len(trigrams), _SLICE):
            part, times = trigrams[low : low + _SLICE], counts[low : low + _SLICE].astype(np.float32)
            at = np.minimum(np.searchsorted(self.keys, part), max(len(self.keys) - 1, 0))
            new = part[self.keys[at] != part] if len(self.keys) else part
            if len(new):
                if self.used + len(new) > _KNOWN:
                    total += times @ bind(part, self.dimensions).astype(np.float32)
                    continue
                self.vectors[self.used : self.used + len(new)] = bind(new, self.dimensions)
                where = np.searchsorted(self.keys, new)
                self.keys = np.insert(self.keys, where, new)
                self.places = np.insert(self.places, where, np.arange(self.used, self.used + len(new)))
                self.used += len(new)
                at = np.searchsorted(self.keys, part)
            total += times @ self.vectors[self.places[at]]
        return total


@lru_cache(maxsize=1)
def _bound(dimensions: int) -> _Bound:
    return _Bound(dimensions)


def text_trigrams(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted trigram numbers of each row; none where the text is null or has no letter."""
    raw, offsets = utf8(column)
    index = letter_index()
    for low, high in chunks(offsets):
        codes, places = code_points(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        letters = np.zeros(len(codes) + len(places), np.int32)  # a border before each row and after the last
        spread = np.ones(len(letters), bool)
        spread[places + np.arange(len(places))] = False
        letters[spread] = index[codes]
        middle = np.flatnonzero(letters > 0)
        trigrams = letters[middle - 1] << 2 * _BITS | letters[middle] << _BITS | letters[middle + 1]
        edges = np.searchsorted(middle, places + np.arange(len(places)))
        for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield np.sort(trigrams[begin:end])


def _counted(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[heads].astype(np.int64), np.diff(np.append(heads, len(ordered)))


def text_vectors(column: pa.Array, dimensions: int = DIMENSIONS) -> Iterator[np.ndarray | None]:
    """The bundle of each row, or None where the text is null or has no letter."""
    bound = _bound(dimensions)
    for ordered in text_trigrams(column):
        yield bound.bundle(*_counted(ordered)) if len(ordered) else None


@dataclass(frozen=True)
class Prototypes:
    """A table of (lang, vector array<long>). Iterating gives the languages in code order."""

    table: DataFrame

    def __iter__(self) -> Iterator[str]:
        return (r.lang for r in self.table.select("lang").orderBy("lang").toLocalIterator())

    def blocks(self) -> Iterator[tuple[list[str], np.ndarray]]:
        """(names, prototypes) of at most ``BLOCK_LANGUAGES`` languages at a time."""
        rest = self.table
        while True:
            page = rest.orderBy("lang").limit(BLOCK_LANGUAGES).toArrow()
            names = page.column("lang").to_pylist()
            if names:
                yield names, np.concatenate([c.flatten().to_numpy() for c in page.column("vector").chunks]).reshape(len(names), -1).astype(np.float64)
            if len(names) < BLOCK_LANGUAGES:
                return
            rest = self.table.where(F.col("lang") > names[-1])


def learn(labelled: DataFrame, dimensions: int = DIMENSIONS) -> Prototypes:
    """Prototype of each language from rows of (text, lang). Sums are whole numbers, so their order does not matter."""

    def add(sums: dict[str, np.ndarray], lang: str, parts: list[np.ndarray]) -> None:
        vector = _bound(dimensions).bundle(*_counted(np.sort(np.concatenate(parts))))
        sums[lang] = sums.get(lang, 0) + np.rint(vector).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            # Bundling is linear: the trigrams of many texts are counted together and bound once.
            waiting: dict[str, list[np.ndarray]] = {}
            sizes: dict[str, int] = {}
            for lang, trigrams in zip(batch.column("lang").to_pylist(), text_trigrams(batch.column("text")), strict=True):
                if len(trigrams):
                    waiting.setdefault(lang, []).append(trigrams)
                    sizes[lang] = sizes.get(lang, 0) + len(trigrams)
                    if sizes[lang] > _TOGETHER:
                        add(sums, lang, waiting.pop(lang))
                        sizes[lang] = 0
            for lang, parts in waiting.items():
                add(sums, lang, parts)
        for lang, vector in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions), pa.array(range(dimensions), pa.int32()), pa.array(vector)], names=["lang", "place", "value"])

    parts = labelled.where("lang IS NOT NULL").select(F.col("text").cast("string").alias("text"), "lang").mapInArrow(run, "lang string, place int, value long")
    summed = parts.groupBy("lang", "place").agg(F.sum("value").alias("value"))
    vector = F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda x: x["value"])
    return Prototypes(materialize(summed.groupBy("lang").agg(vector.alias("vector")), "prototypes"))


def _compared(rows: DataFrame, names: list[str], prototypes: np.ndarray, last: bool) -> DataFrame:
    """Rows with the best language so far; the last pass drops the text."""
    profile = prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-300)
    dimensions = profile.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, scores = batch.column("lang_pred").to_pylist(), batch.column("score").to_numpy().copy()
            for k, vector in enumerate(text_vectors(batch.column("text"), dimensions) if names else ()):
                size = 0.0 if vector is None else float(np.linalg.norm(vector))
                if not size:
                    continue
                cosines = np.round(profile @ vector / size, 12)
                best = int(np.argmax(cosines))
                # Blocks come in code order, so among equal cosines the first language stays.
                if found[k] == UNDETERMINED or cosines[best] > scores[k]:
                    found[k], scores[k] = names[best], cosines[best]
            texts = {} if last else {"text": batch.column("text")}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **texts, "lang_pred": pa.array(found, pa.string()), "score": pa.array(scores)})

    return rows.mapInArrow(run, "doc_id long, " + ("" if last else "text string, ") + "lang_pred string, score double")


def identify(documents: DataFrame, prototypes: Prototypes | Mapping[str, np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred and score, the cosine with the prototype (negative: 0)."""
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    if isinstance(prototypes, Prototypes):
        blocks = prototypes.blocks()
    else:
        names = sorted(prototypes)
        blocks = iter([(names, np.array([prototypes[n] for n in names], np.float64))] if names else [])
    block, after = next(blocks, ([], np.zeros((0, DIMENSIONS)))), next(blocks, None)
    while after is not None:
        rows = materialize(_compared(rows, *block, last=False), "languages")
        block, after = after, next(blocks, None)
    return _compared(rows, *block, last=True).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")))
