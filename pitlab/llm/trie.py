"""Prefix trie of conversations by van Emde Boas recursion.

A sequence is cut at half depth. The half before the cut belongs to an upper trie, the half behind it to the lower trie
below its cut prefix, and both are cut in the same way. All tries of one size are worked on together, as rows, so the
recursion has as many steps as the depth has binary digits:

1. ``segments`` names the aligned runs of 1, 2, 4, ... turns, each from its two halves.
2. ``prefixes`` names the cut prefixes from the largest cut down: a prefix that ends in the middle of a block is the prefix
   at the block's top and the block's first half.
3. ``grafted`` sums totals upward: a block takes what its lower tries have gathered at their tops, from the smallest blocks
   up, and then every node inside a block takes what hangs below it, from the largest blocks down.

A conversation of a third of all turns is therefore spread over as many rows as it has turns. Nothing is gathered by
conversation or by node but sums, which combine in the map task, and the list of the conversations that end at a node, in
blocks of neighbouring ids.

Defined cases. Turns are in the order of turn (null first), then role, then text; rows that repeat all of these are turns of their
own. A null role or text is an empty one. Rows without a conv_id belong to no conversation. No rows give no nodes. Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitlab.session import materialize

_WORD = r"[^\x20\x09-\x0D]+"
#: Conversations whose ids share all but the last 16 bits make one block of a node's list.
_BLOCK_BITS = 16
#: At most so many nodes have so many children that their ids are sent to all tasks.
_HOT_NODES = 1 << 16
_ROOT = "root"


def _named(*parts: Column | str) -> Column:
    """A 128-bit name of what has these parts."""
    return F.unhex(F.md5(F.concat(*(F.col(p) if isinstance(p, str) else p for p in parts))))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turn_name, words): every row of ``conversations`` with its place in its conversation, from 1.

    Rows are sorted over range partitions, which cut a long conversation anywhere, and written; a place is the row's number
    among those of its conversation in its partition, and what earlier partitions hold of the conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        role.alias("role"),
        text.alias("text"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    ranged = turns.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order)
    name = _named(F.char_length("role").cast("string"), F.lit(":"), "role", "text")
    kept = ranged.select(
        "conv_id",
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("at"),
        name.alias("turn_name"),
        F.regexp_count("text", F.lit(_WORD)).cast("long").alias("words"),
    )
    kept = materialize(kept, "trie-turns")
    runs = kept.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    # A conversation has at most one run per range partition.
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1 - F.col("first")).alias("shift"))
    return kept.join(starts, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("place"), "turn_name", "words")


def rebuilt(turns: DataFrame, borrow: int = 4, group: int = 20) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths) of the rebuilt conversations: the first h turns of conversation c - c % group, then c's own after its first h.

    h is crc32(decimal c) % borrow. Lengths have every conversation, also those without turns.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(borrow)).cast("long")
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("own")).withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    sized = lengths.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_own", F.lit(0))))
    sized = materialize(sized.withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "trie-lengths")
    heads = turns.where(F.col("place") < borrow).withColumnRenamed("conv_id", "base")
    borrowed = sized.where("taken > 0").select("conv_id", "base", "taken").join(heads, "base").where("place <= taken").select("conv_id", "place", "turn_name", "words")
    own = turns.withColumn("h", h).where("place > h").join(sized.select("conv_id", "taken"), "conv_id")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "turn_name", "words")
    return borrowed.unionByName(own), sized.select("conv_id", "length")


def segments(turns: DataFrame, steps: int) -> list[DataFrame]:
    """For k below ``steps``: (conv_id, depth, segment, words) of every run of 2**k turns that follows a depth divisible by 2**k.

    ``words`` is that of the run's last turn.
    """
    made = [materialize(turns.select("conv_id", (F.col("place") - 1).alias("depth"), F.col("turn_name").alias("segment"), "words"), "trie-segments")]
    for k in range(steps - 1):
        second = F.col("depth").bitwiseAND(1 << k) != 0
        top = F.when(second, F.col("depth") - (1 << k)).otherwise(F.col("depth"))
        halves = made[-1].groupBy("conv_id", top.alias("depth")).agg(
            F.max(F.when(~second, F.col("segment"))).alias("left"), F.max(F.when(second, F.col("segment"))).alias("right"), F.max(F.when(second, F.col("words"))).alias("words")
        )
        whole = halves.where("left IS NOT NULL AND right IS NOT NULL")
        made.append(materialize(whole.select("conv_id", "depth", _named("left", "right").alias("segment"), "words"), "trie-segments"))
    return made


def prefixes(lengths: DataFrame, runs: list[DataFrame]) -> DataFrame:
    """(conv_id, depth, name, words) of every prefix of every conversation, the empty one included."""
    known = lengths.select("conv_id", F.lit(0).cast("long").alias("depth"), _named(F.lit(_ROOT)).alias("name"), F.lit(0).cast("long").alias("words"))
    for k in reversed(range(len(runs))):
        cut = runs[k].where(F.col("depth").bitwiseAND((1 << (k + 1)) - 1) == 0)
        below = known.select("conv_id", "depth", "name").join(cut, ["conv_id", "depth"])
        depth = F.col("depth") + (1 << k)
        known = known.unionByName(below.select("conv_id", depth.alias("depth"), _named(depth.cast("string"), F.lit(":"), "name", "segment").alias("name"), "words"))
        known = materialize(known, "trie-prefixes")
    return known


def _ancestors(nodes: DataFrame, known: DataFrame, steps: int) -> DataFrame:
    """(name, step, above): for each node and each 2**step that divides its depth, the node 2**step turns above it."""
    deep = nodes.where("depth > 0").select("name", "conv_id", "depth", F.explode(F.sequence(F.lit(0), F.lit(max(steps - 1, 0)))).alias("step"))
    size = F.expr("shiftleft(1L, step)")
    deep = deep.where(F.col("depth") % size == 0).withColumn("depth", F.col("depth") - size)
    return deep.join(known.select("conv_id", "depth", F.col("name").alias("above")), ["conv_id", "depth"]).select("name", "step", "above")


def grafted(nodes: DataFrame, ancestors: DataFrame, steps: int, totals: tuple[str, ...]) -> DataFrame:
    """(name, *totals): each node's own numbers summed over its subtree.

    ``nodes`` has name, depth and the numbers.
    """
    sums = [F.sum(c).alias(f"{c}_below") for c in totals]

    def with_below(tops: DataFrame, lower: DataFrame, k: int) -> DataFrame:
        links = ancestors.where(F.col("step") == k).select("name", "above")
        below = lower.join(links, "name").groupBy(F.col("above").alias("name")).agg(*sums)
        added = [(F.col(c) + F.coalesce(f"{c}_below", F.lit(0))).alias(c) for c in totals]
        return tops.join(below, "name", "left").select("name", "depth", *added)

    inside = lambda k: F.col("depth").bitwiseAND((1 << (k + 1)) - 1) != 0
    left, settled = nodes.select("name", "depth", *totals), []
    for k in range(steps):
        # Tops of blocks of 2**k turns: those in the middle of a larger block hand their sums to its top.
        settled.append(left.where(inside(k)))
        left = materialize(with_below(left.where(~inside(k)), settled[-1], k), "trie-blocks")
    whole = left
    for k in reversed(range(steps)):
        whole = materialize(whole.unionByName(with_below(settled[k], whole, k)), "trie-totals")
    return whole.select("name", *totals)


def _hash_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each name's blocks, which follow one another in the order of ids."""
    name, state = None, None
    for batch in batches:
        done = []
        for key, block in zip(batch.column("name").to_pylist(), batch.column("block").to_pylist()):
            if key != name:
                if name is not None:
                    done.append((name, state.hexdigest()))
                name, state = key, hashlib.sha256(block.encode())
            else:
                state.update(b"," + block.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], names=["name", "ends_sha256"])
    if name is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()])], names=["name", "ends_sha256"])


def ends(known: DataFrame, lengths: DataFrame) -> DataFrame:
    """(name, ends_sha256): the hash of the decimal ids of the conversations that end at a node, ascending and joined by commas.

    The ids of one node are joined in blocks first. Only a node with several blocks has them streamed through one task, in
    order, as a SHA-256 is a chain; the task holds one block and one state.
    """
    last = known.join(lengths.withColumnRenamed("length", "depth"), ["conv_id", "depth"])
    blocks = last.groupBy("name", F.shiftright("conv_id", _BLOCK_BITS).alias("high")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    blocks = materialize(blocks.select("name", "high", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("block")), "trie-ends")
    many = blocks.groupBy("name").agg(F.count("*").alias("n"), F.min("block").alias("block"))
    alone = many.where("n = 1").select("name", F.sha2("block", 256).alias("ends_sha256"))
    long = blocks.join(many.where("n > 1").select("name"), "name", "left_semi").repartition("name").sortWithinPartitions("name", "high")
    return alone.unionByName(long.select("name", "block").mapInArrow(_hash_blocks, "name binary, ends_sha256 string"))


def with_parents(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """Adds parent_conv_id to ``nodes`` (name, parent, ...), given ``parents`` (name, conv_id, n_children).

    The few nodes with most children go to all tasks, so no task gets a hot node's children.
    """
    named = parents.where("n_children > 0").select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    # n nodes have n - 1 children together, so at most _HOT_NODES of them have more than n / _HOT_NODES.
    many = max(1024, nodes.count() // _HOT_NODES)
    hot, others = (named.where(x).drop("n_children") for x in (F.col("n_children") > many, F.col("n_children") <= many))
    hot = F.broadcast(hot.withColumnRenamed("parent_conv_id", "hot_conv_id"))
    found = nodes.join(hot, "parent", "left")
    rest = found.where("hot_conv_id IS NULL").drop("hot_conv_id").join(others, "parent", "left")
    return found.where("hot_conv_id IS NOT NULL").withColumnRenamed("hot_conv_id", "parent_conv_id").unionByName(rest)


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row per node of the trie of conversations, given ``turns`` (conv_id, place, turn_name, words) and ``lengths``.

    (name, conv_id, depth, parent, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).
    """
    deepest = lengths.agg(F.max("length")).first()[0] or 0
    steps = int(deepest).bit_length()
    known = prefixes(lengths, segments(turns, steps) if steps else [])
    counted = known.groupBy("name", "depth").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
    nodes = materialize(counted, "trie-nodes")
    ancestors = materialize(_ancestors(nodes, known, steps), "trie-ancestors")
    parents = ancestors.where("step = 0").select("name", F.col("above").alias("parent"))
    children = parents.groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "name", "left").join(parents, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = nodes.select("*", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    own = materialize(own, "trie-own")
    totals = grafted(own, ancestors, steps, ("n_leaves", "saved_tokens"))
    none = hashlib.sha256(b"").hexdigest()
    placed = with_parents(own.drop("n_leaves", "saved_tokens"), own)
    whole = placed.join(totals, "name").join(ends(known, lengths), "name", "left")
    return whole.select("name", "conv_id", "depth", "parent", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
