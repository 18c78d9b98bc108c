from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_fixtures import docs, prose  # noqa: F401
from pitlab.llm import decontaminate, jaccard, neardup, pii
from pitlab.llm.common import utf8
from pitlab.llm.components import components

LOWER = {c: c + 32 for c in range(65, 91)}


# Personal data ----------------------------------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    keep = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 16 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), "phone": lambda s: 8 <= len(digits(s)) <= 15}
    return {k: [m.span() for m in re.finditer(p, text) if keep[k](m[0])] for k, p in PLAIN.items()}


parts = st.sampled_from(["a", "b.c", "@", "a@b.c", ".", "..", "1", "255", "256", "10.0.0.1", "4111 1111 1111 1111", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "6 7 9 9 9 9 0 1 0 0 0 0 0 0 0 0 0 1 9", "4111-1111", "+1", "+49 (30) 1234-567", "-", " ", "(", "é", "0" * 8, "x_%", "+"])


@settings(max_examples=500, deadline=None)
@given(st.lists(parts, max_size=14).map("".join))
def test_base_spans_equal_the_patterns(text):
    assert pii.detect(text) == plain_spans(text)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write to jane.doe [at] mail [dot] example [dot] com now", "email", "jane.doe [at] mail [dot] example [dot] com"),
        ("write to jane at example dot com now", "email", "jane at example dot com"),
        ("pаul@exаmple.com!", "email", "pаul@exаmple.com"),
        ("ip １９２.１６８.０.１ ok", "ip", "１９２.１６８.０.１"),
        ("call +four nine three zero one two three four five six seven please", "phone", "+four nine three zero one two three four five six seven"),
        ("card 4111​1111​1111​1111.", "card", "4111​1111​1111​1111"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, found):
    base, every = pii.find(text)
    assert not base[kind]
    assert [text[a:b] for a, b in every[kind]] == [found]
    assert found not in pii.redact(text) and f"[{kind.upper()}]" in pii.redact(text)


@pytest.mark.parametrize("text", ["look at the dot on the map", "I was at home. dot", "one two three", "meet me at noon", "Привет, мир"])
def test_clean_texts_stay_clean(text):
    assert not any(pii.find(text)[1].values()) and pii.redact(text) == text


def test_base_spans_stay_beside_added_ones():
    text = "a@b.c and x [at] y [dot] z а 1.2.3.4"
    base, every = pii.find(text)
    assert base["email"] == [(0, 5)] and every["email"][0] == (0, 5) and len(every["email"]) == 2 and every["ip"] == base["ip"]


def test_spans_of_odd_rows(docs):
    texts = [(1, None), (2, ""), (3, "a@b.c"), (3, "a@b.c"), (None, "1.2.3.4"), (5, "x" * 200_000 + "@" + "1" * 200_000)]
    rows = sorted(pii.find_spans(docs(texts)).collect(), key=str)
    empty = hashlib.sha256(b"").hexdigest()
    assert [r.base_sha256 for r in rows if r.doc_id in (1, 2, 5)] == [empty] * 3
    assert [(r.n_email, r.spans) for r in rows if r.doc_id == 3] == [(1, "email:0:5")] * 2
    assert [r.n_ip for r in rows if r.doc_id is None] == [1]
    cleaned = {r.doc_id: r.text for r in pii.redact_documents(docs(texts)).collect()}
    assert cleaned[1] is None and cleaned[3] == "[EMAIL]"
    assert pii.find_spans(docs([(1, "a")]).limit(0)).count() == 0


# Jaccard join -------------------------------------------------------------------------------------------------------


def brute_sets(texts, size=4):
    sets = []
    for _, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    return sets


def brute_components(texts, percent=85):
    sets, parent = brute_sets(texts), {i: i for i, _ in texts if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(texts)):
        for y in range(x):
            (i, _), (j, _) = texts[x], texts[y]
            if i is not None and j is not None and sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return sorted(((i, len(s), None if i is None else find(i)) for (i, _), s in zip(texts, sets, strict=True)), key=str)


def crowd(prose, seed):
    """Copies, near copies of one base, texts made of common passages, short and empty ones."""
    drawn = random.Random(seed)
    base, passages = prose(1, 120).split(), [prose(900 + k, 30) for k in range(4)]
    texts = [(None, "a b c d e"), (0, None), (1, ""), (2, " \t "), (3, "One two"), (4, "one TWO"), (5, "one two three four"), (5, "one two three four")]
    for k in range(10, 130):
        words = list(base)
        for _ in range(drawn.randint(0, 4)):
            words[drawn.randrange(len(words))] = f"w{drawn.randrange(50)}"
        texts.append((k, " ".join(words)))
    texts += [(k, " ".join(drawn.sample(passages, 3)) + f" tail{k} end{k} stop{k} more{k}") for k in range(200, 260)]
    texts += [(k, " ".join(base)) for k in range(300, 340)] + [(k, prose(k, drawn.randint(1, 60))) for k in range(400, 460)]
    drawn.shuffle(texts)
    return texts


@pytest.mark.parametrize("frequent", [64, 3])
def test_join_equals_brute_force(docs, prose, monkeypatch, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT_FROM", frequent)
    texts = crowd(prose, 5)
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_documents(docs(texts)).collect()), key=str)
    assert found == brute_components(texts)


def test_join_of_few_rows(docs):
    assert jaccard.similar_documents(docs([(1, "a")]).limit(0)).count() == 0
    rows = jaccard.similar_documents(docs([(7, "a b c d e f"), (9, "a b c d e f")])).collect()
    assert {(r.doc_id, r.component_id, r.n_shingles) for r in rows} == {(7, 7, 3), (9, 7, 3)}


def test_id_with_several_texts_is_one_node(docs):
    rows = jaccard.similar_documents(docs([(5, "a b c d"), (5, "e f g h"), (2, "a b c d"), (9, "e f g h")])).collect()
    assert {r.component_id for r in rows} == {2}


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 40), min_size=2, max_size=30), st.sets(st.integers(0, 40), max_size=3), st.sets(st.integers(0, 40), max_size=2), st.integers(0, 40))
def test_linked_sets_share_a_signature(x, more, less, frequent):
    """The guarantee of the prefixes, whatever part of the tokens is frequent."""
    y = (x | more) - less
    token = np.sort(np.random.Generator(np.random.PCG64(1)).integers(0, 1 << 63, 41).astype(np.uint64) << np.uint64(1))
    shift = 18
    known = np.arange(41) < frequent
    made = jaccard.Signatures(token[known] >> np.uint64(shift), np.arange(41)[known] % 5 + 64, shift, 85)
    a, b = (np.array(sorted(token[list(s)]), np.uint64) for s in (x, y))
    if x != y and y and 100 * len(x & y) >= 85 * len(x | y):
        assert set(made.of(a)) & set(made.of(b))


# Decontamination ----------------------------------------------------------------------------------------------------


def brute_hits(texts, items, window=13):
    split = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (s or "").translate(LOWER))
    phrases = {}
    for item, text in items:
        w = split(text)
        size = min(window, len(w))
        if item is not None:
            for k in range(len(w) - size + 1 if size else 0):
                phrases.setdefault(tuple(w[k : k + size]), set()).add(str(item))
    rows = []
    for i, t in texts:
        w, hit, found = split(t), set(), set()
        for size in {len(p) for p in phrases}:
            for k in range(len(w) - size + 1):
                if items_ := phrases.get(tuple(w[k : k + size])):
                    found |= items_
                    hit.update(range(k, k + size))
        rows.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(rows, key=str)


@pytest.mark.parametrize("block", [1 << 24, 60])
def test_contamination_equals_brute_force(spark, docs, prose, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 2000)
    items = [(k, prose(k, 16 + k)) for k in range(8)] + [(10, "short Item"), (10, prose(3, 14)), (11, ""), (12, None), (None, prose(4, 20)), (13, prose(2, 18))]
    texts = [(k, prose(50 + k, 40) + " " + prose(k % 10, 22 + k % 9).upper() + ("," if k % 2 else " ") + prose(80 + k, 90 * (k % 4))) for k in range(40)]
    texts += [(100, None), (101, ""), (102, "short-item"), (102, "short-item"), (None, "a short item"), (103, (prose(1, 17) + " ") * 40), (104, "!" * 9000), (105, prose(0, 16)[:-1] + "é")]
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_words int")
    found = decontaminate.contamination(decontaminate.find_spans(docs(texts), benchmark))
    assert sorted((tuple(r)[:6] for r in found.collect()), key=str) == brute_hits(texts, items)
    assert found.where("n_words = 0 AND (n_hit > 0 OR contaminated)").count() == 0


def test_benchmark_blocks_are_bounded_and_hold_each_item_once(spark, prose, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 500)
    items = [(f"i{k}", prose(k, 5 + k)) for k in range(30)] + [("i3", prose(3, 8)), ("i3", prose(3, 8)), ("z", "é" * 900), ("e", "")]
    benchmark = spark.createDataFrame([*items, (None, "x"), ("n", None)], "item_id string, text string")
    blocks = [*decontaminate._blocks(benchmark, "item_id", "text")]
    assert sorted(r for block, _ in blocks for r in block) == sorted(items)
    assert [last for _, last in blocks] == [False] * (len(blocks) - 1) + [True] and len(blocks) > 5
    for block, _ in blocks:
        sizes = [len(t.encode()) for _, t in block]
        assert sum(sizes) - max(sizes) <= 500


def test_phrases_equal_plain_windows(prose):
    items = [("b", prose(1, 20)), ("a", prose(1, 20)), ("b", prose(1, 20)), ("c", "one two"), ("d", "One, two!"), ("e", ""), ("f", (prose(2, 3) + " ") * 20), ("é", "two")]
    want = {}
    for name, text in items:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
        size = min(13, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            want.setdefault(tuple(words[k : k + size]), set()).add(name)
    made = decontaminate.phrases_of(items)
    assert sorted(g.phrases.shape[1] for g in made.groups) == sorted({len(w) for w in want})
    got = sorted((g.phrases.shape[1], [made.names[i] for i in g.items[a:z]]) for g in made.groups for a, z in zip(g.edges[:-1], g.edges[1:], strict=True))
    assert got == sorted((len(w), sorted(found)) for w, found in want.items())


def test_contamination_of_empty_tables(spark, docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in decontaminate.contamination(decontaminate.find_spans(docs([(1, "a b")]), empty)).collect()] == [(1, 2, 0, 0)]
    assert decontaminate.contamination(decontaminate.find_spans(docs([(1, "a")]).limit(0), empty)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.lists(st.integers(1, 4), min_size=1, max_size=4))
def test_fm_index_finds_all_places(text, phrase):
    index = decontaminate.FmIndex(np.array(text, np.int64), 6)
    low, high = index.search(np.array([phrase]))
    found = index.locate(np.arange(low[0], high[0]))
    assert sorted(found.tolist()) == [k for k in range(len(text) - len(phrase) + 1) if text[k : k + len(phrase)] == phrase]


# Near-duplicate vectors -----------------------------------------------------------------------------------------------


def brute_vectors(rows, threshold=0.9):
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and i is not None for i, v in rows]
    scaled = [np.array(v) / np.abs(v).max() if ok else None for ok, (_, v) in zip(good, rows, strict=True)]
    unit = [None if v is None else v / np.linalg.norm(v) for v in scaled]
    n, parent, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(n):
        for y in range(x):
            if good[x] and good[y] and len(unit[x]) == len(unit[y]) and unit[x] @ unit[y] >= threshold:
                links[x] += 1
                links[y] += 1
                parent[find(x)] = find(y)
    least = {}
    for x in range(n):
        if rows[x][0] is not None:
            least[find(x)] = min(least.get(find(x), rows[x][0]), rows[x][0])
    return sorted(((i, k, least.get(find(x)) if i is not None else None) for x, ((i, _), k) in enumerate(zip(rows, links, strict=True))), key=str)


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 40)
    drawn = np.random.Generator(np.random.PCG64(5))
    rows = [(k, drawn.standard_normal(16).tolist()) for k in range(300)]
    centre = drawn.standard_normal(16)
    rows += [(1000 + k, (centre + drawn.standard_normal(16) * 0.25).tolist()) for k in range(150)]
    rows += [(2000 + k, centre.tolist()) for k in range(60)] + [(3000, (-centre).tolist()), (3001, (centre * 1e200).tolist())]
    rows += [(4000, None), (4001, [0.0] * 16), (4002, [float("nan")] + [1.0] * 15), (4003, [None] + [1.0] * 15), (4004, []), (4005, [float("inf")] * 16), (4006, [1.0, 2.0]), (4007, [2.0, 4.0]), (None, centre.tolist()), (5, rows[5][1])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rep int")
    found = neardup.near_duplicates(table, window=16, recall=0.999)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in found.collect()), key=str) == brute_vectors(rows)
    assert found.where("vec_id IS NOT NULL AND kept != (vec_id = component_id)").count() == 0
    assert neardup.near_duplicates(table.limit(0)).count() == 0


def test_pairs_in_a_dense_region_are_found(spark, monkeypatch):
    """A third of the vectors in a cone of pairwise cosine 0.75, and isolated pairs at cosine 0.91 there and elsewhere."""
    drawn, n, dims = np.random.Generator(np.random.PCG64(8)), 6000, 64
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre = unit(drawn.standard_normal(dims))

    def within(x, cosine):
        other = drawn.standard_normal(x.shape)
        return cosine * x + np.sqrt(1 - cosine**2) * unit(other - (other * x).sum(axis=1, keepdims=True) * x)

    data = unit(drawn.standard_normal((n, dims)))
    data[: n // 3] = within(np.tile(centre, (n // 3, 1)), np.sqrt(0.75))
    data[:300] = within(data[300:600], 0.91)
    data[4000:4300] = within(data[4300:4600], 0.91)
    linked = np.triu(data @ data.T >= 0.9, 1)
    table = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(data)], "vec_id long, embedding array<double>")

    def recalls():
        own = {r.vec_id: r.component_id for r in neardup.near_duplicates(table).collect()}
        a, b = np.nonzero(linked)
        met = np.array([own[int(x)] == own[int(y)] for x, y in zip(a, b, strict=True)])
        return met[a < n // 3].mean(), met[a >= n // 3].mean()

    hot, other = recalls()
    assert hot >= 0.99 and other >= 0.98
    # Exact comparison out of reach: further passes alone come to the wanted recall.
    monkeypatch.setattr(neardup, "EXACT_ROWS", 8)
    hot, other = recalls()
    assert hot >= 0.98 and other >= 0.98


def test_components_against_plain_union(spark):
    drawn = random.Random(2)
    links = [(drawn.randrange(300), drawn.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1080)] + [(2000, k) for k in range(2001, 2100)] + [(5, 5), (None, 3)]
    parent = {x: x for link in links for x in link if x is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    met = {x for a, b in links if a is not None and a != b for x in (a, b)}
    found = components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()
    assert {r.id: r.component for r in found} == {x: find(x) for x in met} and len(found) == len(met)


def test_hashes_depend_on_content_only():
    a = jaccard.column_shingles(pa.array(["x y z w v", "q"]), 4)
    b = jaccard.column_shingles(pa.array(["", "pre", "X  y\tz w v"]), 4)
    assert list(a)[0].tolist() == list(b)[2].tolist()
    assert utf8(pa.array([None, "é"]).slice(1))[0].tobytes() == "é".encode()
