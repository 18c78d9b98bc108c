"""Near-duplicate embeddings by sorted projection passes.

Equal vectors are one class first. In every pass the classes are sorted by the concatenated signs of random projections;
each is compared with the ``WINDOW`` before it, and pairs with cosine >= 0.9 in double precision are united. The number
of first passes follows from the number of classes, as if they were spread evenly. Each pass also measures, for each
class, the chance that it met a partner at the threshold: from its own projections (how likely a partner has the same
signs) and from how many rows share each prefix of its signs. Classes that stay below the wanted recall, as in a dense
region, get further passes among themselves, or are compared exactly with each other where that costs less. A pair with
one such class is covered by the measured chance of the other.

Windows bound what a pass compares, not what is counted: inside every component found, all pairs are verified block by
block, so a vector's links are complete there however large its group is. Blocks send back counts, never pairs.

Nulls: a null vector or one with a null or non-finite component, or of norm zero, links with nothing. A null id links with
nothing and has a null component. Vectors of different lengths do not link. Repeated rows are vectors of their own.
An empty table gives no rows. Columns beyond id and vector are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlab.llm.components import components, forest
from pitlab.session import materialize

THRESHOLD = 0.9
WINDOW = 64
TARGET_RECALL = 0.99
BITS = 62
PASSES_AT_ONCE = 8
BLOCK_ROWS = 512
#: Rows of a block of the exact comparison. A further pass costs about as much as comparing each row with so many.
EXACT_ROWS = 2048
MOST_FURTHER_PASSES = 64
_SEED, _TILE = 99, 512


def passes_for(classes: int, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = TARGET_RECALL) -> int:
    """Passes after which a pair at the threshold has met in some window with chance ``recall`` if vectors are spread evenly."""
    same = 1 - math.acos(threshold) / math.pi
    chance = same ** max(0.0, math.log2(max(classes, 1) / window))
    return 2 if chance > 0.9 else math.ceil(math.log(1 - recall) / math.log(1 - chance))


@lru_cache(maxsize=64)
def _projection(number: int, dimensions: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([_SEED, number, dimensions])).standard_normal((dimensions, BITS))


def _unit(rows: list[bytes] | pa.Array) -> np.ndarray:
    """Rows of float64 bytes of one length as unit vectors."""
    data = np.frombuffer(b"".join(x.as_py() if isinstance(x, pa.Scalar) else x for x in rows), np.float64).reshape(len(rows), -1)
    # Scaling by the largest component first keeps the squares finite.
    data = data / np.abs(data).max(axis=1, keepdims=True)
    return data / np.sqrt((data * data).sum(axis=1, keepdims=True))


def _usable(vector: str) -> Column:
    ok = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(vector).isNotNull() & ok & F.exists(F.col(vector), lambda x: x != 0), F.lit(False))


def classes_of(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(rows, classes): every row with its class hashes (null if unusable), and one row per distinct vector."""
    base = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    ok = _usable("v") & F.col("vec_id").isNotNull()
    # +0.0 makes the two zeros one value.
    rows = base.withColumn("v", F.when(ok, F.transform("v", lambda x: x + F.lit(0.0)))).withColumn("h1", F.when(ok, F.xxhash64("v"))).withColumn("h2", F.when(ok, F.xxhash64(F.lit(7), "v")))
    found = rows.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
    return rows.select("vec_id", "h1", "h2"), found


def _packed(found: DataFrame) -> DataFrame:
    """The vectors of the classes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.array(x, np.float64).tobytes() for x in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h1", "h2", "rep", "copies")), pa.array(data, pa.binary())], names=["h1", "h2", "rep", "copies", "v"])

    return found.mapInArrow(run, "h1 long, h2 long, rep long, copies long, v binary")


def _keys(found: DataFrame, numbers: list[int]) -> DataFrame:
    """One row per class and pass, with the concatenated signs as a whole number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            data, rep = batch.column("v"), batch.column("rep")
            sizes = np.array([len(x) // 8 for x in data.to_pylist()], np.int64)
            for dimensions in np.unique(sizes):
                own = pa.array(np.flatnonzero(sizes == dimensions))
                part, ids = data.take(own), rep.take(own)
                unit = _unit(part.to_pylist())
                for number in numbers:
                    key = (unit @ _projection(number, int(dimensions)) >= 0) @ power
                    n = len(own)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number, np.int64)), pa.array(np.full(n, dimensions)), pa.array(key), ids, part], names=["pass", "size", "key", "rep", "v"])

    return found.select("rep", "v").mapInArrow(run, "pass long, size long, key long, rep long, v binary")


def _met(unit: np.ndarray, keys: np.ndarray, projection: np.ndarray, threshold: float, window: int) -> np.ndarray:
    """The chance of each row of a sorted stretch to have a partner at the threshold, in a random direction, in its window.

    A partner shares sign j with a chance that the row's own distance from plane j gives. Two rows that part after
    ``d`` signs lie in the two halves of the stretch with these signs; places in the halves count as even. A stretch that
    reaches an end of the rows may go on beyond and counts as met by nobody.
    """
    n, dimensions = unit.shape
    margin = np.abs(unit @ projection)
    spread = np.sqrt(np.maximum((projection * projection).sum(axis=0) - margin * margin, 1e-12) / max(dimensions - 1, 1))
    z = np.minimum(threshold / math.sqrt(max(1 - threshold * threshold, 1e-12)) * margin / spread, 8.0)
    same = 0.5 * (1 + np.tanh(math.sqrt(2 / math.pi) * (z + 0.044715 * z**3)))  # the normal distribution's integral
    chance, shared = np.zeros(n), np.ones(n)
    for depth in range(BITS + 1):
        prefix = keys >> np.int64(BITS - depth)
        edges = np.concatenate(([0], np.flatnonzero(prefix[1:] != prefix[:-1]) + 1, [n]))
        sizes = np.diff(edges).astype(np.float64)
        ratio = window / np.maximum(sizes, window)
        met = np.where(ratio > 0.5, 1 - 2 * (1 - ratio) ** 2, 2 * ratio**2)
        met[[0, -1]] = 0.0
        parts = same[:, depth] if depth < BITS else np.zeros(n)
        chance += shared * (1 - parts) * np.repeat(met, np.diff(edges))
        shared = shared * parts
    return chance


def _windows(keyed: DataFrame, threshold: float, window: int) -> DataFrame:
    """Links (a, b) that join what the windows of a sorted partition unite: at most one per row and tile.

    Each row also gives (a, null, miss): the logarithm of its chance to have missed a partner at the threshold in this pass.
    """
    columns = ["a", "b", "miss"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: tuple[tuple[int, int], np.ndarray, np.ndarray] | None = None
        for batch in batches:
            group = np.stack([batch.column(c).to_numpy() for c in ("pass", "size")])
            ids, data = batch.column("rep").to_numpy(), batch.column("v")
            edges = np.concatenate(([0], np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1, [len(ids)])) if len(ids) else [0]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                own = (int(group[0, low]), int(group[1, low]))
                whole = _unit(data.slice(low, high - low).to_pylist())
                met = _met(whole, batch.column("key").to_numpy()[low:high], _projection(*own), threshold, window)
                miss = np.log1p(-np.minimum(met, 1 - 1e-12))
                yield pa.RecordBatch.from_arrays([pa.array(ids[low:high]), pa.nulls(high - low, pa.int64()), pa.array(miss)], names=columns)
                for begin in range(low, high, _TILE):
                    end = min(begin + _TILE, high)
                    unit, rep = whole[begin - low : end - low], ids[begin:end]
                    if tail is not None and tail[0] == own:
                        unit, rep = np.concatenate((tail[1], unit)), np.concatenate((tail[2], rep))
                    left, right = np.nonzero(np.triu(unit @ unit.T >= threshold, 1) & (np.abs(np.subtract.outer(np.arange(len(rep)), np.arange(len(rep)))) <= window))
                    tail = (own, unit[-window:], rep[-window:])
                    if len(left):
                        node, root = forest(rep[left], rep[right])
                        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root), pa.nulls(len(node), pa.float64())], names=columns)

    return keyed.mapInArrow(run, "a long, b long, miss double")


def _exact(rows: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that join all pairs of ``rows`` (rep, size, v): each two blocks are compared, with at most one link a row."""
    sizes = F.broadcast(rows.groupBy("size").agg(F.ceil(F.count("*") / EXACT_ROWS).cast("long").alias("blocks")))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    dealt = rows.join(sizes, "size").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("size", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "v")
    dealt = dealt.repartition("size", "i", "j").sortWithinPartitions("size", "i", "j")

    def compared(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rep = np.concatenate([p.column("rep").to_numpy() for p in parts])
        unit = _unit([x for p in parts for x in p.column("v").to_pylist()])
        a, b = [], []
        for begin in range(0, len(rep), _TILE):
            left, right = np.nonzero(unit[begin : begin + _TILE] @ unit[begin:].T >= threshold)
            node, root = forest(rep[begin + left], rep[begin + right])
            a.append(node)
            b.append(root)
        node, root = forest(np.concatenate(a), np.concatenate(b))
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("size", "i", "j")])
            edges = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [len(batch)])) if len(batch) else [0]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                key = tuple(keys[:, low].tolist())
                if key != now and held:
                    yield compared(held)
                    held = []
                now = key
                held.append(batch.slice(low, high - low))
        if held:
            yield compared(held)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _links(found: DataFrame, threshold: float, window: int, recall: float) -> DataFrame:
    """Links (a, b) that join the classes: passes over all, then over those whose measured recall is too low."""
    count, wanted = found.count(), math.log(1 - recall)
    passes, done, rows, missed, links = passes_for(count, threshold, window, recall), 0, found.select("rep", "v"), None, None
    while True:
        for first in range(done, done + passes, PASSES_AT_ONCE):
            keyed = _keys(rows, list(range(first, min(first + PASSES_AT_ONCE, done + passes))))
            placed = keyed.repartitionByRange("pass", "size", "key", "rep").sortWithinPartitions("pass", "size", "key", "rep")
            both = materialize(_windows(placed, threshold, window), "vector-links")
            part, miss = both.where("b IS NOT NULL").select("a", "b").distinct(), both.where("b IS NULL").select(F.col("a").alias("rep"), "miss")
            links = part if links is None else links.unionByName(part)
            missed = miss if missed is None else missed.unionByName(miss)
        missed = materialize(missed.groupBy("rep").agg(F.sum("miss").alias("miss")).where(F.col("miss") > wanted), "vectors-missed")
        done += passes
        left = missed.agg(F.count("*").alias("rows"), F.avg("miss").alias("miss")).first()
        if not left.rows:
            return links
        rows = materialize(rows.join(missed, "rep", "left_semi"), "vectors-left")
        # What a class gained in a pass so far, on average, says how many more it needs.
        needed = (wanted - left.miss) / min(left.miss / done, -1e-9)
        if left.rows <= EXACT_ROWS * max(1.0, needed):
            sized = rows.select("rep", F.octet_length("v").cast("long").alias("size"), "v")
            return links.unionByName(materialize(_exact(sized, threshold), "vector-links-exact"))
        passes = min(MOST_FURTHER_PASSES, max(1, math.ceil(needed)))


def _link_counts(members: DataFrame, threshold: float) -> DataFrame:
    """(rep, links): verified links of each class to the others of its component, weighted by copies.

    A component of n classes is n / BLOCK_ROWS blocks; a task compares two blocks at a time.
    """
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("long").alias("blocks"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    rows = members.join(sizes, "component").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "copies", "v")
    rows = rows.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "own")

    def counted(i: int, j: int, parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        own, rep, copies = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 2))
        data = [x for p in parts for x in p[3]]
        links = np.zeros(len(rep), np.int64)
        lengths = np.array([len(x) for x in data])
        for length in np.unique(lengths):
            same = np.flatnonzero(lengths == length)
            unit = _unit([data[k] for k in same])
            linked = unit @ unit.T >= threshold
            linked = linked | linked.T
            np.fill_diagonal(linked, False)
            if i != j:  # pairs inside one block are counted where i = j
                linked &= np.not_equal.outer(own[same], own[same])
            links[same] = linked @ copies[same]
        return rep, links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("component", "i", "j")])
            edges = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [len(batch)])) if len(batch) else [0]
            made = []
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                key = tuple(keys[:, low].tolist())
                if key != now and held:
                    made.append(counted(now[1], now[2], held))
                    held = []
                now = key
                part = batch.slice(low, high - low)
                held.append((part.column("own").to_numpy(), part.column("rep").to_numpy(), part.column("copies").to_numpy(), part.column("v").to_pylist()))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([m[k] for m in made])) for k in (0, 1)], names=["rep", "links"])
        if held:
            rep, links = counted(now[1], now[2], held)
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links)], names=["rep", "links"])

    return rows.mapInArrow(run, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, window: int = WINDOW, recall: float = TARGET_RECALL) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows, found = classes_of(vectors, key, vector)
    found = materialize(_packed(found), "vector-classes")
    grouped = components(_links(found, threshold, window, recall)).withColumnRenamed("id", "rep")
    members = materialize(found.join(grouped, "rep"), "vector-members")
    counts = _link_counts(members.select("component", "rep", "copies", "v"), threshold)
    summary = found.select("h1", "h2", "rep", "copies").join(members.select("rep", "component"), "rep", "left").join(counts, "rep", "left")
    summary = summary.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    joined = rows.join(summary, ["h1", "h2"], "left")
    result = joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return result.withColumn("kept", F.col("vec_id") == F.col("component_id"))
