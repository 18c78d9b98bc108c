"""Quality by supervised subword embeddings.

Every white-space word, its character n-grams (3 and 4, with the word's borders) and a mark for each word that repeats the
word before it are hashed into ``BUCKETS`` rows of a
table of learned vectors. A document is the average of its vectors; softmax over two classes gives its score. Vectors and
output weights are trained together by stochastic gradient descent in numpy.

Training takes at most ``SAMPLE_DOCS`` labelled documents, those with the smallest hash of their id (a documented bound;
features are made on the executors, at most ``BUCKETS`` numbers a document). Scoring covers every whole text. As softmax of an average
is linear in the vectors, the workers get one weight per bucket, 0.5 MB at any size of the input.

Null and empty texts have no feature and get the score of the bias alone. Labels of null id or value are dropped; an id
labelled both ways takes the majority, a tie is dropped. With no or one class to learn, the score is that class's share (0.5
for none). Repeated rows are scored one by one. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlab.llm.bytepairs import SPACE, classes, code_points
from pitlab.llm.common import CHUNK_BYTES, chunks, mix, span_hashes, tidy, utf8

BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
SAMPLE_DOCS = 6000
WIDTH, STEPS, RATE, SEED = 16, 12_000, 0.1, 7

_AGAIN = np.uint64(0xA6A1)
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


@dataclass(frozen=True)
class LinearModel:
    """The trained network as one weight per bucket: the difference of the two classes' outputs."""

    weights: np.ndarray
    bias: float

    def probability(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(sums / np.maximum(counts, 1) + self.bias, -60, 60)))


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, rows): one bucket per word and per n-gram of every row, not in any order."""
    codes, places = code_points(raw, offsets)
    symbols = np.zeros(len(codes) + len(places), np.uint64)
    borders = places + np.arange(len(places))
    spread = np.ones(len(symbols), bool)
    spread[borders] = False
    symbols[spread] = np.where(classes()[codes] == SPACE, 0, codes.astype(np.uint64) + np.uint64(1))
    inner = symbols > 0
    starts = np.flatnonzero(inner[1:] & ~inner[:-1]) + 1
    ends = np.flatnonzero(inner[:-1] & ~inner[1:]) + 1
    words = span_hashes(symbols, starts, ends)
    hashes, at = [words], [starts]
    if len(words) > 1:  # a word that follows itself within the row
        again = np.flatnonzero((words[1:] == words[:-1]) & (np.searchsorted(borders, starts[1:]) == np.searchsorted(borders, starts[:-1]))) + 1
        hashes.append(np.full(len(again), mix(np.array([_AGAIN]))[0]))
        at.append(starts[again])
    for size in (3, 4):
        if len(symbols) < size:
            continue
        last = len(symbols) - size + 1
        whole = inner[1:last + 1].copy()
        for k in range(2, size - 1):
            whole &= inner[k : last + k]
        where = np.flatnonzero(whole)
        value = np.full(len(where), np.uint64(size), np.uint64)
        for k in range(size):
            value += symbols[where + k] * _MULTIPLIERS[k]
        hashes.append(mix(value))
        at.append(where + 1)  # the first inner symbol; the border before it may be the row's own
    every = np.concatenate(hashes)
    return (every >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.searchsorted(borders, np.concatenate(at), side="right") - 1


def row_features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and their counts of each row."""
    raw, offsets = utf8(column)
    for low, high in chunks(offsets, CHUNK_BYTES):
        found, rows = features(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        order = np.argsort(rows, kind="stable")
        edges = np.searchsorted(rows[order], np.arange(high - low + 1))
        for begin, end in zip(edges[:-1], edges[1:], strict=True):
            yield np.unique(found[order[begin:end]], return_counts=True)


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], width: int = WIDTH, steps: int = STEPS, rate: float = RATE, seed: int = SEED) -> LinearModel:
    """Averaged subword vectors under softmax, by stochastic gradient descent over (buckets, counts, label)."""
    labels = np.array([y for _, _, y in samples], int)
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        return LinearModel(np.zeros(BUCKETS, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    drawn = np.random.Generator(np.random.PCG64(seed))
    vectors = drawn.uniform(-1 / width, 1 / width, (BUCKETS, width)).astype(np.float32)
    output, bias = np.zeros((width, 2), np.float32), np.zeros(2, np.float32)
    scaled = [(ids, (counts / counts.sum()).astype(np.float32), y) for ids, counts, y in samples if len(ids)]
    done = 0
    while done < steps and scaled:
        for k in drawn.permutation(len(scaled))[: steps - done]:
            ids, share, label = scaled[k]
            rows = vectors[ids]
            mean = share @ rows
            logits = mean @ output + bias
            chance = np.exp(logits - logits.max())
            chance /= chance.sum()
            chance[label] -= 1.0
            step = np.float32(rate * (1 - done / steps))
            back = output @ chance
            output -= step * np.outer(mean, chance)
            bias -= step * np.float32(0.1) * chance
            # The average divides by the document's length; its vectors take a step as if they were one.
            vectors[ids] = rows - (step * np.minimum(share * np.float32(len(ids)), np.float32(8.0)))[:, None] * back[None, :]
            done += 1
    apart = output[:, 1] - output[:, 0]
    return LinearModel((vectors @ apart).astype(np.float32), float(bias[1] - bias[0]))


def majority(labels: DataFrame, value: str, key: str = "doc_id") -> DataFrame:
    """One 0 or 1 per labelled id."""
    kept = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(value).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    mean = kept.groupBy("doc_id").agg(F.avg("y").alias("share"))
    return mean.where("share != 0.5").select("doc_id", (F.col("share") > 0.5).cast("int").alias("y"))


def learn(documents: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> LinearModel:
    """The model of a bounded sample of labelled documents; ``labels`` has doc_id and y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(row_features(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), pa.array([x.astype(np.int32).tobytes() for x, _ in found], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in found], pa.binary())],
                names=["doc_id", "y", "ids", "counts"],
            )

    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    # A bounded table: at most sample_docs rows of 12 bytes.
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.mapInArrow(tidy(run), "doc_id long, y int, ids binary, counts binary")
    once = rows.groupBy("doc_id").agg(F.max(F.struct("y", "ids", "counts")).alias("r")).select("doc_id", "r.*")
    samples = [(r.doc_id, np.frombuffer(r.ids, np.int32), np.frombuffer(r.counts, np.int32), r.y) for r in once.toLocalIterator()]
    return train([x[1:] for x in sorted(samples, key=lambda x: x[0])])


def score(documents: DataFrame, model: LinearModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every column of ``documents`` is dropped but its key; adds ``score``, the chance of label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score_column(batch.column("text"), model))], names=["doc_id", "score"])

    return documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, score double")


def score_column(column: pa.Array, model: LinearModel) -> np.ndarray:
    """The score of each row of a string column."""
    raw, offsets = utf8(column)
    result = np.zeros(len(column), np.float64)
    for low, high in chunks(offsets, CHUNK_BYTES):
        found, rows = features(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        counts = np.bincount(rows, minlength=high - low)
        result[low:high] = model.probability(np.bincount(rows, weights=model.weights[found], minlength=high - low), counts)
    return result
