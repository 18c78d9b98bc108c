from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
from llm_fixtures import docs, prose  # noqa: F401
from pyspark.sql import functions as F

from pitlab.llm import sharding

SCHEMA = "doc_id long, text string"


def placed(frame):
    """Rows of a sharded frame as {shard: [(slot, doc_id, text, size)]}, with slots checked to be gapless."""
    found = defaultdict(list)
    for r in frame.collect():
        found[r["shard"]].append((r["slot"], r["doc_id"], r["text"], r["size"]))
    for rows in found.values():
        rows.sort(key=lambda r: r[0])
        assert [r[0] for r in rows] == list(range(len(rows)))
    return found


def size(text):
    return len((text or "").encode()) + 1


def held(found):
    return sorted(((r[1], r[2]) for rows in found.values() for r in rows), key=str)


def test_bytes_are_near_equal_and_copies_stay_together(spark, docs, prose):  # noqa: F811
    rows = [(k, prose(k, 5 + k % 90)) for k in range(1500)] + [(2000 + k, prose(k % 40, 30) + "é") for k in range(400)]
    found = placed(sharding.shard(docs(rows)))
    assert held(found) == sorted(rows, key=str)
    sizes = [sum(r[3] for r in found[s]) for s in range(16)]
    assert all(r[3] == size(r[2]) for rows in found.values() for r in rows)
    largest = max(size(t) for _, t in rows)
    mean = sum(sizes) / 16
    assert max(abs(s - mean) for s in sizes) <= largest + sharding.TOLERANCE * mean
    where = defaultdict(set)
    for s, kept in found.items():
        for r in kept:
            where[r[2]].add(s)
    # Only a group of copies that outweighs the largest row is cut, between two neighbouring shards.
    for text, shards in where.items():
        assert len(shards) == 1 or (max(shards) - min(shards) == 1 and size(text) * sum(t == text for _, t in rows) > largest)
    assert sum(len(shards) > 1 for shards in where.values()) < 15


def test_a_third_of_all_rows_may_be_one_text(spark, docs, prose):  # noqa: F811
    hot = prose(1, 40)
    rows = [(k, hot) for k in range(1500)] + [(5000 + k, prose(k, 40)) for k in range(2000)]
    frame = docs(rows)
    found = placed(sharding.shard(frame))
    assert held(found) == sorted(rows, key=str)
    sizes = [sum(r[3] for r in found[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 2 * max(size(t) for _, t in rows) + 2 * sharding.TOLERANCE * sum(sizes) / 16
    # The hot text takes neighbouring shards, and shares at most two of them with other texts.
    own = sorted(s for s, kept in found.items() if any(r[2] == hot for r in kept))
    assert own == list(range(own[0], own[-1] + 1))
    assert sum(any(r[2] != hot for r in found[s]) for s in own) <= 2
    again = placed(sharding.shard(frame.repartition(7)))
    assert {s: [r[1:] for r in kept] for s, kept in again.items()} == {s: [r[1:] for r in kept] for s, kept in found.items()}


def test_counts_are_exact_between_candidates(spark, prose):  # noqa: F811
    drawn = random.Random(5)
    rows = [(drawn.choice([3, 9, 1 << 40, drawn.getrandbits(62)]), drawn.getrandbits(3), drawn.getrandbits(62), drawn.randint(1, 50)) for _ in range(800)]
    keys = spark.createDataFrame(rows, ", ".join(f"{k} long" for k in sharding._KEYS) + ", size long").repartition(5)
    bounds = sorted({(0, 0, 0), (3, 0, 0), (3, 4, 0), (9, 0, 0), (9, 2, 1 << 60), (9, 2, 1 << 61), (1 << 40, 5, 0), (1 << 61, 0, 0), *((r[0], r[1], r[2]) for r in rows[:40])})
    found = sharding.count_between(keys, bounds, [True] * len(bounds))
    want = defaultdict(list)
    for r in rows:
        want[max(k for k, b in enumerate(bounds) if b <= r[:3])].append(r)
    assert {k: (i.size, i.rows, i.largest) for k, i in found.items()} == {k: (sum(r[3] for r in v), len(v), max(r[3] for r in v)) for k, v in want.items()}
    for k, v in want.items():
        assert found[k].least == tuple(min(r[j] for r in v) for j in range(3)) and found[k].most == tuple(max(r[j] for r in v) for j in range(3))
    some = sharding.count_between(keys, bounds, [k % 2 == 0 for k in range(len(bounds))])
    assert some == {k: i for k, i in found.items() if k % 2 == 0}


def test_place_compares_all_parts():
    drawn = random.Random(7)
    bounds = sorted({(drawn.randint(0, 4), drawn.randint(0, 3), drawn.randint(0, 3)) for _ in range(40)})
    keys = [(drawn.randint(0, 5), drawn.randint(0, 3), drawn.randint(0, 3)) for _ in range(300)]
    got = sharding.place([np.array([k[j] for k in keys]) for j in range(3)], sharding._columns(bounds))
    assert got.tolist() == [sum(b <= k for b in bounds) for k in keys]


def test_odd_rows(spark, prose):  # noqa: F811
    schema = "doc_id long, text string, shard string, slot double, size map<string,int>, row int, shard_piece int, bin long, rank int"
    long = prose(2, 4000)
    texts = [(1, None), (2, ""), (None, "a b"), (None, None), (3, long), (3, long), (4, "same"), (4, "same"), (5, "é" * 10)]
    frame = spark.createDataFrame([(i, t, "x", 1.0, {"a": 1}, 5, 6, 7, 8) for i, t in texts], schema)
    made = sharding.shard(frame)
    assert sorted(made.columns) == sorted(["doc_id", "text", "row", "shard_piece", "bin", "rank", "size", "shard", "slot"])
    found = placed(made)
    assert held(found) == sorted(texts, key=str)
    assert {r["rank"] for r in made.collect()} == {8}
    assert made.where("doc_id = 5").first()["size"] == 21 and made.where("text IS NULL").first()["size"] == 1
    assert sharding.shard(frame.limit(0)).collect() == []
    same = spark.createDataFrame([(1, "t")] * 900, SCHEMA).repartition(3)
    assert [len(v) for v in placed(sharding.shard(same, shards=3)).values()] == [300, 300, 300]


def test_pieces_are_bounded(spark, prose):  # noqa: F811
    rows = [(k, "" if k % 3 else prose(k, 20)) for k in range(3000)]
    keys = sharding.keyed(spark.createDataFrame(rows, SCHEMA), [F.col("doc_id")], sharding.text_size())
    intervals, chosen, limit = sharding.histogram(keys, 16, sharding.TOLERANCE)
    assert limit == 64 and max(i.rows for i in intervals) <= limit
    bounds, shards, slots = sharding.pieces(intervals, chosen, limit)
    assert bounds == sorted(bounds) and shards == sorted(shards) and len(bounds) == len(set(bounds))


def test_written_shards_hold_all_texts(spark, docs, prose, tmp_path):  # noqa: F811
    rows = [(k, prose(k, 20)) for k in range(200)]
    sharding.write_shards(docs(rows), f"{tmp_path}/out", shards=4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert held(placed(back)) == sorted(rows, key=str)
    assert sorted(p.name for p in tmp_path.glob("out/shard=*")) == [f"shard={k}" for k in range(4)]
