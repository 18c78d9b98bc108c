"""Connected components of links, by alternating large and small stars on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlab.session import materialize

#: Links that one task contracts at a time.
_BLOCK = 1 << 20
#: Tasks over which the neighbours of one node are spread.
SALTS = 64


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root): each node of the links with the smallest node of its component, roots left out."""
    nodes, places = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right = places[: len(a)], places[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        fresh = label.copy()
        # Hook both roots and both ends to the smaller label, then shorten all paths.
        for where in (label[left], label[right], left, right):
            np.minimum.at(fresh, where, low)
        while True:
            short = fresh[fresh]
            if np.array_equal(short, fresh):
                break
            fresh = short
        if np.array_equal(fresh, label):
            break
        label = fresh
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contracted(links: DataFrame) -> DataFrame:
    """Fewer links with the same components: a forest of each block of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            node, root = forest(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["a", "b"])

        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            size += len(batch)
            if size >= _BLOCK:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return links.mapInArrow(run, "a long, b long")


def _with_least(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Adds ``m``, the least ``value`` of each row's ``key``, with a hub's rows spread over ``SALTS`` tasks.

    The least of each salt is taken first, which leaves a hub at most ``SALTS`` rows; they tell it to the rows of their salt.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(value), F.lit(SALTS)))
    parts = salted.groupBy(key, "salt").agg(F.min(value).alias("part"))
    least = parts.groupBy(key).agg(F.min("part").alias("m"))
    return salted.join(parts.select(key, "salt").join(least, key), [key, "salt"]).drop("salt")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b), the smallest id it reaches. Rows with a null or a = b are ignored.

    Every round writes its links to the shared folder, so no lineage grows and a lost executor costs one round. Links are
    contracted by blocks of rows before the first, and the neighbours of a hub are spread by ``_with_least``.
    """
    edges = materialize(_contracted(links.where("a != b").select("a", "b")).where("a != b"), "links")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, "a", "b").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a != b").distinct()
        large = materialize(large, "large-star")
        # In (a, b) above, b < a: a small star hooks a's smaller neighbours and a itself to the smallest of them.
        low = _with_least(large, "a", "b")
        small = low.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        edges = materialize(small, "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
