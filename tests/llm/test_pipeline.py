from __future__ import annotations

import random
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from llm_fixtures import prose  # noqa: F401
from test_search import brute_components, brute_hits
from test_tokens import WORDS, check_pieces
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from pitlab.llm import pii, quality  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, prose):  # noqa: F811
    """Tables with junk, near copies, benchmark passages, personal data and odd rows."""
    place = str(tmp_path_factory.mktemp("tables"))
    junk = lambda k: " ".join("!!" + w + "!!" for w in prose(k, 50).split())
    texts = [(k, prose(k, 60)) for k in range(60)] + [(100 + k, junk(k)) for k in range(30)]
    texts += [(200 + k, prose(k, 60) + " x") for k in range(20)] + [(300, prose(3, 60)), (300, prose(3, 60))]
    texts += [(400 + k, prose(700 + k, 40) + " " + prose(500 + k, 20)) for k in range(5)] + [(450 + k, prose(800 + k, 900) + " " + prose(500 + k, 20)) for k in range(3)]
    texts += [(500 + k, prose(600 + k, 30) + f" mail{k}@example.com and 10.0.0.{k} " + prose(650 + k, 30)) for k in range(5)]
    texts += [(600, None), (601, ""), (None, prose(77, 50))]
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{place}/documents.parquet")
    labels = [(k, 1, 0) for k in range(50)] + [(100 + k, 0, 0) for k in range(25)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame([(k, prose(500 + k, 20)) for k in range(5)], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return place


def prose_of(seed):
    return " ".join(random.Random(seed).choice(["orchard", "river", "stone", "winter", "candle", "meadow", "harbour", "silver"]) + str(random.Random(seed * 99 + k).randint(0, 99)) for k in range(60))


def stage(k, spark, docs, folder):  # noqa: F811
    made = corpus_pipeline.STAGES[k][1](spark, docs, folder)
    if k < 4:
        assert made.columns == docs.columns
    return made


def held(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)


def test_stages_against_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    def written(frame, name):
        frame.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    good = written(stage(0, spark, docs, folder), "good")
    model = quality.learn(docs, quality.majority(spark.read.parquet(f"{folder}/labels.parquet"), "quality"))
    alone = lambda t: float(quality.score_column(pa.array([t], pa.string()), model)[0])
    assert held(good) == [x for x in held(docs) if alone(x[1]) >= 0.7]
    assert not [i for i, _ in held(good) if i is not None and 100 <= i < 130] and {k for k in range(60)} <= {i for i, _ in held(good)}

    one = written(stage(1, spark, good, folder), "one")
    rows = held(good)
    keep = {i for i, _, c in brute_components(rows) if i == c and i is not None}
    assert held(one) == sorted({x for x in rows if x[0] in keep} | {x for x in rows if x[0] is None}, key=str)
    assert not {i for i, _ in held(one) if i and 200 <= i < 220}

    clean = written(stage(2, spark, one, folder), "clean")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute_hits(held(one), items) if r[5]}
    assert bad == {400 + k for k in range(5)} and held(clean) == [x for x in held(one) if x[0] not in bad]

    redacted = written(stage(3, spark, clean, folder), "redacted")
    assert held(redacted) == sorted(((i, None if t is None else pii.redact(t)) for i, t in held(clean)), key=str)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in redacted.collect())
    assert not any(any(pii.find(t or "")[1].values()) for _, t in held(redacted))

    texts = [(i, t) for i, t in held(redacted)]
    check_pieces(stage(4, spark, redacted, folder).collect(), texts, Tokenizer.from_file(WORDS), 2048)


def test_similar_from_four_fifths(spark, prose):  # noqa: F811
    """Copies with 18 to 25 % new words appended go, copies with more stay."""
    rows = [(k, prose(k, 200)) for k in range(3)]
    added = {100: 38, 101: 44, 102: 48, 103: 60}
    rows += [(i, prose(0, 200) + " " + prose(i, n)) for i, n in added.items()]
    texts = {i: t.split() for i, t in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in texts.items()}
    ratio = {i: len(sets[0] & sets[i]) / len(sets[0] | sets[i]) for i in added}
    assert all(0.8 <= ratio[i] < 0.85 for i in (100, 101, 102)) and ratio[103] < 0.8
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {i for i, _ in held(corpus_pipeline.keep_one_of_each_group(spark, docs, ""))} == {0, 1, 2, 103}


def test_all_texts_of_an_id_stay(spark, prose):  # noqa: F811
    """Only equal rows of an id are one; of other columns the smallest values stay."""
    first, second, third = (prose(k, 60) for k in (1, 2, 3))
    rows = [(1, first, "b"), (1, first, "a"), (1, second, "c"), (2, third, "d"), (1, None, "e"), (5, second, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, first, "a"), (1, second, "c"), (1, None, "e"), (2, third, "d")], key=str)


def test_run_applies_all_stages(spark, folder):
    found = {r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").distinct().collect()}
    assert 3 in found and 203 not in found and 402 not in found and 105 not in found and 451 in found
    assert len(corpus_pipeline.STAGES) == 5


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for k in range(4):
        docs = stage(k, spark, docs, folder)
        assert docs.columns == COLUMNS
    assert stage(4, spark, docs, folder).count() == 0


def test_stages_keep_columns_of_any_name_and_type(spark, folder):
    """Maps, and names that the stages use themselves, come through; an id with several texts keeps each once."""
    texts = [(1, prose_of(1)), (2, prose_of(1) + " end"), (3, prose_of(3)), (3, prose_of(3)), (3, prose_of(4)), (4, None), (None, prose_of(5)), (5, "")]
    rows = [(i, t, "en", {"k": n}, ["x"], 1.5, "r", 2, 3, {"a": (1, 2)}, 7) for n, (i, t) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, any map<string,int>, items array<string>, row double, starts string, place int, n_words int, ends map<string,struct<x:int,y:int>>, `a.b` int"
    docs = spark.createDataFrame(rows, schema).repartition(2)
    for k in range(4):
        made = stage(k, spark, docs, folder)
        assert [f.dataType for f in made.schema] == [f.dataType for f in docs.schema]
        found = made.collect()
        assert all(r["any"] is not None and r["ends"]["a"]["y"] == 2 and r["a.b"] == 7 for r in found)
        if k == 1:
            assert len(found) == 6 and {(r["doc_id"], r["text"]) for r in found} == {(1, prose_of(1)), (3, prose_of(3)), (3, prose_of(4)), (4, None), (5, ""), (None, prose_of(5))}
    assert stage(4, spark, docs, folder).where("doc_id = 3").count() >= 3
    empty = docs.limit(0)
    assert all(stage(k, spark, empty, folder).count() == 0 for k in range(5))
