from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from pitlab.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Every prefix of every rebuilt conversation in dictionaries."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in turns.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in turns}
    whole = {c: tuple(turns.get(c - c % 20, [])[: h[c]] + turns[c][h[c] :]) for c in turns}
    members, children = defaultdict(list), defaultdict(set)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
            if d:
                children[seq[: d - 1]].add(seq[:d])
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        own = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += own
    ends = {p: ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p)) for p, m in members.items()}
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest())
        for p, m in members.items()
    )


def nodes(frame):
    made = trie.prefix_trie(*trie.rebuilt(trie.numbered_turns(frame)))
    return sorted(tuple(r) for r in made.select(*COLUMNS).collect())


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    drawn = random.Random(seed)
    text = lambda: drawn.choice(["a", "b b", "", None, "c\tc c c", "long " * 50])
    rows = []
    for conv in drawn.sample(range(200), 60):
        for turn in range(drawn.choice([1, 2, 3, 4, 7, 8, 9, 20])):
            rows.append((conv, drawn.choice([turn, turn, None]), drawn.choice(["user", "user", "assistant", None]), text()))
    rows += rows[:7] + [(None, 1, "user", "a")]
    drawn.shuffle(rows)
    assert nodes(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_one_conversation_of_many_turns_and_one_shared_start(spark):
    drawn = random.Random(9)
    rows = [(20, k, "user", drawn.choice("ab")) for k in range(150)]
    rows += [(1000 + c, k, "user", "hello" if k < 5 else f"{c} {k}") for c in range(60) for k in range(drawn.randint(1, 7))]
    rows += [(5000 + c, k, "user", "same words") for c in range(0, 400, 20) for k in range(3)]
    assert nodes(spark.createDataFrame(rows, SCHEMA).repartition(4)) == brute(rows)


def test_places_go_on_over_range_partitions(spark):
    rows = [(7, k, "user", f"w{k}") for k in range(500)] + [(8, None, "b", "x"), (8, None, "a", "y"), (8, 0, "a", "x")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = trie.numbered_turns(spark.createDataFrame(rows, SCHEMA).repartition(6))
        assert numbered.groupBy("conv_id").count().count() == 2
        assert sorted(r["place"] for r in numbered.where("conv_id = 7").collect()) == list(range(1, 501))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    eight = {r["place"]: r["turn_name"] for r in numbered.where("conv_id = 8").collect()}
    assert len(eight) == 3 and len(set(eight.values())) == 3
    assert nodes(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_ends_are_hashed_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "_BLOCK_BITS", 3)
    rows = [(c, 0, "user", "same") for c in range(0, 2000, 20)] + [(c, 0, "user", "other") for c in (2000, 2020)]
    assert nodes(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_hot_parents_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(trie, "_HOT_NODES", 1)
    rows = [(c, k, "user", "first" if k == 0 else f"{c}.{k}") for c in range(0, 24000, 20) for k in range(2)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert len({c for c, k, *_ in rows}) > 1024
    assert nodes(frame) == brute(rows)


def test_odd_tables(spark):
    assert nodes(spark.createDataFrame([], SCHEMA)) == []
    assert nodes(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)) == []
    alone = [(3, 0, "user", "x")]  # takes its first turns from conversation 0, which is not there
    assert nodes(spark.createDataFrame(alone, SCHEMA)) == brute(alone)
    rows = [(20, 0, "user", "a b"), (20, 1, None, None), (21, None, "user", "a b")]
    extra = spark.createDataFrame([(*r, 1, "x", {"k": 1}) for r in rows], SCHEMA + ", depth int, name string, words map<string,int>")
    assert nodes(extra) == brute(rows)
