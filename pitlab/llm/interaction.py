"""How filters of a corpus interact: what each removes in every order, and its exact Shapley value.

The set of filters that a document fails is a mask of bits. Counts by mask answer for every coalition of filters how many
documents it removes together, and the differences of coalitions are the steps of every order. Shapley values come from
constrained least squares: additive values that fit the 30 proper coalitions best under the Shapley kernel's weights and
add up to what all filters remove. The normal equations are solved in rationals, once for all parts, as they do not
depend on the counts.

Defined cases. A null text is an empty one, which has no words and no characters and fails only A (and E, if a smaller id has an
empty text too). A null source is the part ''. A null id is smaller than no id and larger than none: it never fails E and
makes no other fail. Rows that repeat an id are documents of their own; equal texts of the same id do not make each other
fail. A document is good or toxic if any label row of its id says 1. No documents give no rows. Extra columns are not read.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlab.llm.common import checked
from pitlab.session import materialize

FILTERS = "ABCDE"
EVERY = (1 << len(FILTERS)) - 1

_WORD = r"[^\x20\x09-\x0D]+"
_COUNTS = ("n", "good", "toxic")


def _solved(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """X with ``matrix`` X = ``right``, by elimination in rationals."""
    rows = [left + values for left, values in zip(matrix, right)]
    for k in range(len(rows)):
        pivot = next(i for i in range(k, len(rows)) if rows[i][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for i in range(len(rows)):
            if i != k and rows[i][k]:
                factor = rows[i][k]
                rows[i] = [x - factor * y for x, y in zip(rows[i], rows[k])]
    return [row[len(matrix) :] for row in rows]


def shapley_weights(players: int) -> list[list[Fraction]]:
    """For each player, the weight of every coalition's value (by mask) in the player's Shapley value.

    The values x minimise the sum over proper coalitions S of kernel(S) * (v(S) - sum of x over S)**2 under
    sum x = v(everyone). With one multiplier for the constraint these are linear equations, whose right sides are written
    out per coalition here.
    """
    full = (1 << players) - 1
    equations = [[Fraction(0)] * (players + 1) for _ in range(players + 1)]
    right = [[Fraction(0)] * (full + 1) for _ in range(players + 1)]
    for mask in range(1, full):
        size = mask.bit_count()
        kernel = Fraction(players - 1, comb(players, size) * size * (players - size))
        inside = [i for i in range(players) if mask >> i & 1]
        for i in inside:
            right[i][mask] += kernel
            for j in inside:
                equations[i][j] += kernel
    for i in range(players):
        equations[i][players] = equations[players][i] = Fraction(1)
    right[players][full] = Fraction(1)
    return _solved(equations, right)[:players]


def failures(docs: DataFrame) -> DataFrame:
    """(id, part, text_hash, mask, n): how many rows of ``docs`` (doc_id, text, source) share an id, a part and a text.

    ``mask`` has the bits of A to D, which depend on the text alone. The text travels as its SHA-256.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    words = read.withColumn("words", F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)))
    counted = words.select(
        "id", "part", "text",
        F.size("words").alias("n_words"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
    )
    capitals = F.octet_length(F.regexp_replace("text", "[^A-Z]+", ""))
    conditions = (
        F.col("n_words") < 200,
        100 * F.col("n_distinct") < 50 * F.col("n_words"),
        100 * capitals.cast("long") > 2 * F.char_length("text").cast("long"),
        F.col("text").rlike("[#$%&*|]"),
    )
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions)), F.lit(0))
    judged = counted.select("id", "part", F.unhex(F.sha2("text", 256)).alias("text_hash"), mask.alias("mask"))
    return judged.groupBy("id", "part", "text_hash", "mask").agg(F.count("*").alias("n"))


def with_copies(failed: DataFrame) -> DataFrame:
    """Adds the bit of E to masks: the text is also that of a smaller id.

    Of each text only the smallest id is kept, by an aggregation that combines in the map task, and it is joined by text
    and id, so that the copies of one text are spread by their ids.
    """
    first = failed.where("id IS NOT NULL").groupBy("text_hash").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    later = F.col("id").isNotNull() & F.col("first").isNull()
    return failed.join(first, ["text_hash", "id"], "left").withColumn("mask", F.col("mask") + F.when(later, 1 << 4).otherwise(0)).drop("first")


def with_labels(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds good and toxic: rows whose id has a label row (doc_id, quality, toxic) with 1."""
    said = [F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(name) for c, name in (("quality", "is_good"), ("toxic", "is_toxic"))]
    marked = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(*said).where("is_good OR is_toxic")
    return failed.join(checked(marked), "id", "left").select(
        "part", "mask", "n",
        F.when(F.col("is_good"), F.col("n")).otherwise(0).alias("good"),
        F.when(F.col("is_toxic"), F.col("n")).otherwise(0).alias("toxic"),
    )


def coalitions(counted: DataFrame) -> DataFrame:
    """Per part: n documents, and arrays n_gone, good_gone, toxic_gone of what each coalition (by mask) removes together.

    ``counted`` has part, mask, n, good, toxic.
    """
    by_mask = counted.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in _COUNTS))
    hit = lambda s, c: F.sum(F.when(F.col("mask").bitwiseAND(s) != 0, F.col(c)).otherwise(0))
    tabled = by_mask.groupBy("part").agg(F.sum("n").alias("all"), *(hit(s, c).alias(f"{c}_{s}") for c in _COUNTS for s in range(EVERY + 1)))
    return tabled.select("part", "all", *(F.array(*(f"{c}_{s}" for s in range(EVERY + 1))).alias(f"{c}_gone") for c in _COUNTS))


def _orders() -> Column:
    """All orders of the filters, each with the mask before its first step and after every one."""
    found = []
    for order in permutations(range(len(FILTERS))):
        masks = [0]
        for k in order:
            masks.append(masks[-1] | 1 << k)
        found.append(F.struct(F.lit("".join(FILTERS[k] for k in order)).alias("filter_order"), F.array(*map(F.lit, masks)).alias("masks")))
    return F.array(*found)


def audit(tabled: DataFrame) -> DataFrame:
    """A row per part, order and step: documents kept, removed and so on, as differences of coalitions.

    ``shapley`` is the filter's value times the number of orders, an integer: its removals summed over all orders.
    """
    orders = factorial(len(FILTERS))
    weights = [[w * orders for w in row] for row in shapley_weights(len(FILTERS))]
    values = [sum((int(w) * F.col("n_gone")[s] for s, w in enumerate(row)), F.lit(0)) for row in weights]
    steps = (
        tabled.withColumn("values", F.array(*values))
        .withColumn("taken", F.explode(_orders()))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
        .withColumn("before", F.col("taken.masks")[F.col("step") - 1])
        .withColumn("after", F.col("taken.masks")[F.col("step")])
    )
    at = lambda c, mask: F.element_at(f"{c}_gone", mask + 1)
    single = F.col("after") - F.col("before")
    removed = lambda c: at(c, F.col("after")) - at(c, F.col("before"))
    bit = F.ascii(F.substring("taken.filter_order", F.col("step"), F.lit(1))) - ord(FILTERS[0])
    return steps.select(
        "part",
        F.col("taken.filter_order").alias("filter_order"),
        "step",
        (F.col("all") - at("n", F.col("after"))).alias("kept"),
        removed("n").alias("removed"),
        (at("n", single) - removed("n")).alias("redundant"),
        (at("n", F.lit(EVERY)) - at("n", F.lit(EVERY) - single)).alias("unique_fails"),
        removed("good").alias("good_lost"),
        removed("toxic").alias("toxic_lost"),
        F.element_at("values", bit + 1).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over ``docs`` (doc_id, text, source) and ``labels`` (doc_id, quality, toxic)."""
    failed = with_copies(materialize(failures(docs), "filter-failures"))
    return audit(coalitions(with_labels(failed, labels)))
