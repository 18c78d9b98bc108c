from __future__ import annotations

import random
import re
from collections import defaultdict
from fractions import Fraction
from itertools import permutations
from math import factorial

import pytest
from llm_fixtures import prose  # noqa: F401

from pitlab.llm import interaction

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(rows, labels):
    """Plays all orders, document by document."""
    good, toxic = ({i for i, *said in labels if i is not None and said[k] == 1} for k in (0, 1))
    texts = [(i, t or "", s or "") for i, t, s in rows]
    least = {}
    for i, t, _ in texts:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    parts = defaultdict(list)
    for i, t, s in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and least[t] < i,
        }
        parts[s].append((i, {f for f, x in fails.items() if x}))
    out = {}
    for part, items in parts.items():
        shapley = defaultdict(int)
        for order in permutations("ABCDE"):
            left = items
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                failing = sum(f in x[1] for x in items)
                alone = sum(x[1] == {f} for x in items)
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), alone, sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def audited(docs, labels):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COUNTS] for r in interaction.audit_filters(docs, labels).collect()}


@pytest.fixture(scope="module")
def rows(prose):  # noqa: F811
    drawn = random.Random(3)
    found = []
    for k in range(120):
        text = prose(k % 70, drawn.choice([30, 199, 200, 260]))
        text = drawn.choice([text, text, text.upper(), text + " #", ("ab cd e " * 130) + text[:50], text.capitalize() + "|"])
        found.append((k, text, drawn.choice(["web", "book", None, ""])))
    found += [(k, found[k % 7][1], "web") for k in range(200, 240)] + found[:3]
    return found + [(300, None, None), (301, "", "web"), (None, found[0][1], "book"), (None, None, "web"), (302, "\u000b \t\r", "web"), (303, "É" * 900, "caps")]


def test_against_brute_force(spark, rows):
    labels = [(k, k % 2, None if k % 5 else 1) for k in range(0, 220, 3)] + [(0, 1, 0), (0, 0, 1), (None, 1, 1), (300, 1, 1)]
    docs = spark.createDataFrame([(*r, 1.0, "x", {"a": 1}) for r in rows], DOCS + ", mask double, part string, n map<string,int>").repartition(4)
    got = audited(docs, spark.createDataFrame(labels, LABELS))
    assert got == brute(rows, labels)
    assert len(got) == 600 * len({p for p, *_ in got}) and {"", "web", "book", "caps"} == {p for p, *_ in got}


def test_odd_tables(spark):
    empty, none = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audited(empty, none) == {}
    one = [(1, "word " * 50_000, "s")]
    assert audited(spark.createDataFrame(one, DOCS), none) == brute(one, [])
    same = [(k, "x", "s") for k in range(40)] + [(7, "x", "s")] * 5
    assert audited(spark.createDataFrame(same, DOCS).repartition(3), none) == brute(same, [])


@pytest.mark.parametrize("players", [2, 3, 5])
def test_normal_equations_give_shapley_values(players):
    drawn = random.Random(players)
    worth = [0, *(drawn.randint(-50, 50) for _ in range((1 << players) - 1))]
    weights = interaction.shapley_weights(players)
    for i in range(players):
        want = Fraction(0)
        for order in permutations(range(players)):
            before = sum(1 << k for k in order[: order.index(i)])
            want += worth[before | 1 << i] - worth[before]
        assert sum(w * v for w, v in zip(weights[i], worth)) == want / factorial(players)
        assert all((w * factorial(players)).denominator == 1 for w in weights[i])
