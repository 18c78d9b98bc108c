"""Toxicity by class-conditional Kneser-Ney models.

Two letter models of order 4, one of the toxic and one of the ordinary training texts, are interpolated Kneser-Ney:
counts at the top order, numbers of distinct left neighbours below. Orders 2 to 4 are counted by class. Both classes
share the counts of the lowest order, so an expression that is rare in a class is judged by what both classes have
seen. A text's evidence is the difference of its two log-likelihoods divided by its length in letters; a
logistic curve fitted on labelled rows that were kept out of the counts turns it into the score. Only rows that are
chosen for the curve stay out: of each class a quarter, and at most half of ``CALIBRATION_DOCS``, weighted to the class's size.

All counting, smoothing and joining is done on DataFrames over all other labelled rows. A finished model of up to
``MODEL_ROWS`` n-grams and contexts goes to the workers as hashed tables that hold the n-grams themselves, so no n-gram
is taken for another. A larger model stays a DataFrame: the n-gram counts of the texts are joined with it.

Null text and text without a letter have no evidence: their score is that of evidence 0. Labels are cleaned as for the
quality model. If a class is missing, the score is the share of toxic labels (0.5 without labels). Repeated rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlab.llm.bytepairs import code_points
from pitlab.llm.common import chunks, mix, utf8
from pitlab.llm.langid import letter_index
from pitlab.session import materialize

ORDER, DISCOUNT = 4, 0.75
#: N-grams and contexts of a model that is sent to the workers, at most: some 80 MB.
MODEL_ROWS = 1 << 22
#: Rows that fit the logistic curve, at most.
CALIBRATION_DOCS = 20_000
_BITS = 10
_MASK = (1 << _BITS) - 1


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(grams, edges): the 4-grams of letters of each row, packed into whole numbers, and where each row's begin.

    A run of other characters is one border symbol; a row begins and ends with one.
    """
    codes, places = code_points(raw, offsets)
    letters = np.zeros(len(codes) + len(places), np.int64)
    borders = places + np.arange(len(places))
    spread = np.ones(len(letters), bool)
    spread[borders] = False
    letters[spread] = letter_index()[codes]
    kept = np.ones(len(letters), bool)
    kept[1:] = (letters[1:] > 0) | (letters[:-1] > 0)
    # A border after another 0 would make two: it goes, and the symbol before stands for it.
    kept[borders[1:]] = letters[borders[1:] - 1] > 0
    symbols = letters[kept]
    at = np.cumsum(kept) - 1
    edges = at[borders]  # the border that opens each row, and closes the one before
    n = max(len(symbols) - ORDER + 1, 0)
    packed = np.zeros(n, np.int64)
    for k in range(ORDER):
        packed = packed << _BITS | symbols[k : k + n]
    sizes = np.maximum(np.diff(edges) + 1 - (ORDER - 1), 0)
    first = np.minimum(edges[:-1], n)
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, first, sizes > 0)
    np.add.at(inside, np.minimum(first + sizes, n), -(sizes > 0).astype(np.int64))
    valid = np.cumsum(inside)[:n] > 0
    return packed[valid], np.concatenate(([0], np.cumsum(sizes)))


def _cell(gram: np.ndarray, bits: int) -> np.ndarray:
    return (mix(gram.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass(frozen=True)
class Table:
    """N-grams of one order with their values: sorted by hash cell, with the place where each cell begins."""

    keys: np.ndarray
    values: np.ndarray
    starts: np.ndarray
    bits: int

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Table:
        bits = max(1, (2 * len(keys)).bit_length())
        place = _cell(keys, bits)
        order = np.argsort(place, kind="stable")
        starts = np.searchsorted(place[order], np.arange((1 << bits) + 1)).astype(np.int32)
        return cls(keys[order], values[order].astype(np.float64), starts, bits)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The value of each n-gram, NaN if it is not in the table."""
        place = _cell(wanted, self.bits)
        at, end = self.starts[place].astype(np.int64), self.starts[place + 1]
        found = np.full(len(wanted), np.nan)
        live = np.flatnonzero(at < end)
        while len(live):
            same = self.keys[at[live]] == wanted[live]
            found[live[same]] = self.values[at[live[same]]]
            live = live[~same]
            at[live] += 1
            live = live[at[live] < end[live]]
        return found


@dataclass(frozen=True)
class ClassModels:
    """Differences of the log-likelihoods, toxic minus ordinary, and the curve over them.

    ``seen[k]`` has the difference of a known k-gram; ``weights[k]`` that of the backoff weights after a context of k.
    """

    seen: dict[int, Table]
    weights: dict[int, Table]
    slope: float
    offset: float

    def evidence(self, column: pa.Array) -> np.ndarray:
        raw, offsets = utf8(column)
        result = np.zeros(len(column), np.float64)
        for low, high in chunks(offsets):
            packed, edges = grams(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            total = np.zeros(len(packed) + 1, np.float64)
            np.cumsum(self._differences(packed), out=total[1:])
            result[low:high] = (total[edges[1:]] - total[edges[:-1]]) / np.maximum(np.diff(edges), 1)
        return result

    def _differences(self, packed: np.ndarray) -> np.ndarray:
        value = self.seen[ORDER].find(packed)
        left, order = np.flatnonzero(np.isnan(value)), ORDER
        value[left] = 0.0
        while len(left) and order > 1:
            context = packed[left] >> _BITS & (1 << _BITS * (order - 1)) - 1
            value[left] += np.nan_to_num(self.weights[order - 1].find(context))
            order -= 1
            if order == 1:
                break  # the lowest order is shared: no difference
            known = self.seen[order].find(packed[left] & (1 << _BITS * order) - 1)
            found = ~np.isnan(known)
            value[left[found]] += known[found]
            left = left[~found]
        return value


@dataclass(frozen=True)
class JoinedModels:
    """The same as DataFrames (order, gram, value), for models beyond ``MODEL_ROWS``."""

    seen: DataFrame
    weights: DataFrame
    slope: float
    offset: float

    def differences(self, found: DataFrame) -> DataFrame:
        """(gram, value) of the 4-grams of ``found`` (gram)."""
        rows = found.select("gram", F.lit(0.0).alias("value"), F.lit(False).alias("known"))
        for order in range(ORDER, 1, -1):
            own = self.seen.where(F.col("order") == order).select(F.col("gram").alias("own"), F.col("value").alias("difference"))
            context = self.weights.where(F.col("order") == order - 1).select(F.col("gram").alias("context"), F.col("value").alias("weight"))
            rows = rows.withColumn("own", F.col("gram").bitwiseAND(F.lit((1 << _BITS * order) - 1))).withColumn("context", F.shiftright("own", _BITS))
            rows = rows.join(own, "own", "left").join(context, "context", "left")
            more = F.coalesce("difference", "weight", F.lit(0.0))
            rows = rows.select("gram", F.when(F.col("known"), F.col("value")).otherwise(F.col("value") + more).alias("value"), (F.col("known") | F.col("difference").isNotNull()).alias("known"))
        return rows.select("gram", "value")


def count_grams(labelled: DataFrame) -> DataFrame:
    """(gram, c0, c1) over all labelled texts; ``labelled`` has text and y. Each task sums before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = np.array(batch.column("y").to_pylist(), np.int64)
            raw, offsets = utf8(batch.column("text"))
            for low, high in chunks(offsets, 1 << 22):
                packed, edges = grams(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                toxic = np.repeat(kind[low:high], np.diff(edges))
                keys, counts = np.unique(packed << 1 | toxic, return_counts=True)
                even, odd = keys & 1 == 0, keys & 1 == 1
                yield pa.RecordBatch.from_arrays([pa.array(keys >> 1), pa.array(np.where(even, counts, 0)), pa.array(np.where(odd, counts, 0))], names=["gram", "c0", "c1"])

    found = labelled.select(F.col("text").cast("string").alias("text"), "y").mapInArrow(run, "gram long, c0 long, c1 long")
    return found.groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def learn(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The model's rows: (order, gram, n, value) of known n-grams and (order, gram, n, value) of contexts' weights."""
    by_order = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        mask = (1 << _BITS * order) - 1
        suffix = F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")
        wider = by_order[order + 1].withColumn("gram", suffix)
        by_order[order] = wider.groupBy("gram").agg(F.sum((F.col("c0") > 0).cast("long")).alias("c0"), F.sum((F.col("c1") > 0).cast("long")).alias("c1"), F.count("*").alias("both"))
    # The lowest order, shared: a symbol's distinct left neighbours in either class. At most 1,024 rows.
    everything = Window.partitionBy(F.lit(0))
    lower = by_order[1].select("gram", (F.col("both") / F.sum("both").over(everything)).alias("p0")).withColumn("p1", F.col("p0"))
    seen, weights = [], []
    for order in range(2, ORDER + 1):
        after = Window.partitionBy("context")
        rows = by_order[order].select("gram", F.shiftright("gram", _BITS).alias("context"), F.col("gram").bitwiseAND(F.lit((1 << _BITS * (order - 1)) - 1)).alias("suffix"), "c0", "c1")
        for c, k in (("c0", "0"), ("c1", "1")):
            total = F.sum(c).over(after)
            cut = F.sum(F.least(F.col(c).cast("double"), F.lit(DISCOUNT))).over(after)
            rows = rows.withColumn(f"w{k}", F.when(total > 0, cut / total).otherwise(1.0)).withColumn(f"s{k}", F.when(total > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / total).otherwise(0.0))
        below = lower.select(F.col("gram").alias("suffix"), F.col("p0").alias("l0"), F.col("p1").alias("l1"))
        lower = rows.join(below, "suffix").select("gram", "context", (F.col("c0") + F.col("c1")).alias("n"), "w0", "w1", (F.col("s0") + F.col("w0") * F.col("l0")).alias("p0"), (F.col("s1") + F.col("w1") * F.col("l1")).alias("p1"))
        lower = materialize(lower, f"toxicity-order{order}")
        seen.append(lower.select(F.lit(order).alias("order"), "gram", "n", F.log(F.col("p1") / F.col("p0")).alias("value")))
        by_context = lower.groupBy("context").agg(F.sum("n").alias("n"), F.max("w0").alias("w0"), F.max("w1").alias("w1"))
        weights.append(by_context.select(F.lit(order - 1).alias("order"), F.col("context").alias("gram"), "n", F.log(F.col("w1") / F.col("w0")).alias("value")))
    return seen[0].union(seen[1]).union(seen[2]), weights[0].union(weights[1]).union(weights[2])


def _tables(rows: DataFrame, orders: range) -> dict[int, Table]:
    """The model's rows as tables. At most ``MODEL_ROWS`` rows reach the driver."""
    got = rows.select("order", "gram", "value").toArrow()
    order, gram, value = (got.column(c).to_numpy() for c in ("order", "gram", "value"))
    return {k: Table.of(gram[order == k], value[order == k]) for k in orders}


def _model(seen: DataFrame, weights: DataFrame) -> ClassModels | JoinedModels:
    """The model without its curve."""
    seen, weights = (materialize(x.select("order", "gram", "value"), f"toxicity-{name}") for x, name in ((seen, "seen"), (weights, "weights")))
    if seen.count() + weights.count() > MODEL_ROWS:
        return JoinedModels(seen, weights, 1.0, 0.0)
    return ClassModels(_tables(seen, range(2, ORDER + 1)), _tables(weights, range(1, ORDER)), 1.0, 0.0)


def _with_evidence(rows: DataFrame, model: ClassModels | JoinedModels) -> DataFrame:
    """The rows with ``evidence`` in place of ``text``."""
    others = [c for c in rows.columns if c != "text"]
    if isinstance(model, ClassModels):
        shared = rows.sparkSession.sparkContext.broadcast(model)  # bounded: see MODEL_ROWS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(shared.value.evidence(batch.column("text")))], names=[*others, "evidence"])

        return rows.mapInArrow(run, ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in others), "evidence double"]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            for low, high in chunks(offsets):
                packed, edges = grams(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                keys, counts = np.unique(np.repeat(np.arange(high - low), np.diff(edges)) << _BITS * ORDER | packed, return_counts=True)
                row = pa.array(low + (keys >> _BITS * ORDER))
                yield pa.RecordBatch.from_arrays([batch.column("h1").take(row), batch.column("h2").take(row), pa.array(keys & (1 << _BITS * ORDER) - 1), pa.array(counts)], names=["h1", "h2", "gram", "n"])

    # Evidence belongs to the text: equal texts add to both sums alike.
    keyed = rows.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(7), "text"))
    counted = materialize(keyed.select("h1", "h2", "text").mapInArrow(count, "h1 long, h2 long, gram long, n long"), "toxicity-document-grams")
    values = materialize(model.differences(counted.select("gram").distinct()), "toxicity-values")
    found = counted.join(values, "gram").groupBy("h1", "h2").agg((F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("evidence"))
    return keyed.join(found, ["h1", "h2"], "left").select(*others, F.coalesce("evidence", F.lit(0.0)).alias("evidence"))


def fit_curve(evidence: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over weighted rows, by Newton steps with a small ridge on the slope."""
    weights = weights / weights.mean()
    scale = float(evidence.std()) or 1.0
    x = np.stack([evidence / scale, np.ones(len(evidence))], axis=1)
    beta = np.zeros(2)
    ridge = np.diag([0.05, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weights * p * (1 - p))[:, None]) + ridge, x.T @ (weights * (labels - p)) - ridge @ beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0] / scale), float(beta[1])


def _curve_rows(labelled: DataFrame, most: int) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, y) of the rows that fit the curve, and by class the documents that each of them stands for.

    Of each class a quarter of its documents, at most half of ``most`` and at least one.
    """
    ids = materialize(labelled.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("y").alias("y")), "toxicity-ids")
    sizes = {r.y: r["count"] for r in ids.groupBy("y").count().collect()}
    quota = {y: min(max(most // 2, 1), max(1, n // 4)) for y, n in sizes.items()}
    parts = [ids.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit("curve")), "doc_id").limit(n) for y, n in sorted(quota.items())]
    chosen = parts[0] if parts else ids
    for part in parts[1:]:
        chosen = chosen.unionByName(part)
    return materialize(chosen, "toxicity-curve"), {y: sizes[y] / n for y, n in quota.items()}


def train(labelled: DataFrame, calibration_docs: int = CALIBRATION_DOCS) -> ClassModels | JoinedModels:
    """The models of all rows of (doc_id, text, y) but those chosen to fit the curve: a bounded number of each class.

    The only document of a class does both.
    """
    chosen, weights_of = _curve_rows(labelled, calibration_docs)
    sizes = {r.y: r["count"] for r in chosen.groupBy("y").count().collect()}
    apart = chosen.where(F.col("y").isin([y for y in sizes if sizes[y] * weights_of[y] > 1])).select("doc_id")
    counts = materialize(count_grams(labelled.join(F.broadcast(apart), "doc_id", "left_anti")), "toxicity-counts")
    seen, weights = learn(counts)
    bare = _model(seen, weights)
    if len(sizes) < 2:
        share = labelled.agg(F.avg("y")).first()[0]
        share = 0.5 if share is None else min(max(share, 1e-3), 1 - 1e-3)
        return replace(bare, slope=0.0, offset=float(np.log(share / (1 - share))))

    held = labelled.join(F.broadcast(chosen.select("doc_id")), "doc_id").select("doc_id", F.col("text").cast("string").alias("text"), "y")
    rows = _with_evidence(held, bare).groupBy("doc_id").agg(F.max("y").alias("y"), F.max("evidence").alias("evidence")).orderBy("doc_id").toArrow()
    evidence, labels = rows.column("evidence").to_numpy(), rows.column("y").to_numpy().astype(float)
    slope, offset = fit_curve(evidence, labels, np.where(labels > 0, weights_of[1], weights_of[0]))
    return replace(bare, slope=slope, offset=offset)


def score(documents: DataFrame, model: ClassModels | JoinedModels, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id and score, the chance that it is toxic."""
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    odds = F.least(F.greatest(F.lit(model.slope) * F.col("evidence") + F.lit(model.offset), F.lit(-60.0)), F.lit(60.0))
    return _with_evidence(rows, model).select("doc_id", (1 / (1 + F.exp(-odds))).alias("score"))
