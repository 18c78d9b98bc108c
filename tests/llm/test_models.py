from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_fixtures import docs, prose  # noqa: F401
from pitlab.llm import langid, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def accuracy(found, labels, column):
    return found.join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col(column)).cast("int"))).first()[0]


def test_languages_held_out(spark):
    found = queries.op2_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = found.where("held_out AND lang IS NOT NULL").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out and 0 <= r.score <= 1 for r in found.collect())


def test_language_of_odd_rows(docs, spark):
    learned = langid.learn(spark.createDataFrame([("the cat sat there", "en"), ("der hund ist da", "de"), (None, "fr"), ("12 !", "fr"), ("x", None)], "text string, lang string"))
    assert sorted(learned) == ["de", "en"]
    rows = {r.doc_id: r for r in langid.identify(docs([(1, None), (2, ""), (3, "1 2 3"), (4, "the cat"), (5, "der hund " * 30_000), (6, "日本")]), learned).collect()}
    assert [rows[k].lang_pred for k in range(1, 6)] == ["und", "und", "und", "en", "de"] and rows[1].score == 0.0 and 0 <= rows[6].score <= 1
    assert {r.lang_pred for r in langid.identify(docs([(1, "abc")]), {}).collect()} == {"und"}


@pytest.mark.parametrize("block", [2, 3, 4096])
def test_languages_against_brute_force_cosines_in_any_blocks(docs, prose, spark, monkeypatch, block):
    """Documents get the first language of the greatest cosine; equal prototypes are ties; repeated rows and empty tables."""
    import pyarrow as pa

    monkeypatch.setattr(langid, "BLOCK_LANGUAGES", block)
    alphabets = ["abc", "bcd", "cde", "abc", "xyz", "aeo"]
    text = lambda letters, k: " ".join("".join(random.Random(k + j).choices(letters, k=4)) for j in range(12))
    learned = [(text(letters, k), f"l{n}") for n, letters in enumerate(alphabets) for k in range(3)] + [(text("abc", k), "a0") for k in range(3)]
    prototypes = langid.learn(spark.createDataFrame(learned, "text string, lang string"))
    names = sorted({lang for _, lang in learned})
    assert list(prototypes) == names
    bundle = lambda t: next(langid.text_vectors(pa.array([t])))
    sums = np.array([sum(bundle(t) for t, lang in learned if lang == n) for n in names])
    asked = [(k, text(alphabets[k % 6], 100 + k)) for k in range(20)] + [(3, text("abc", 103))] * 2 + [(50, None), (51, "7")]
    got = sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.identify(docs(asked), prototypes).collect())
    want = []
    for k, t in asked:
        vector = bundle(t) if t else None
        if vector is None:
            want.append((k, "und", 0.0))
            continue
        cosines = sums @ vector / np.linalg.norm(sums, axis=1) / np.linalg.norm(vector)
        best = next(n for n in range(len(names)) if cosines[n] >= cosines.max() - 1e-12)
        want.append((k, names[best], round(min(1.0, max(0.0, cosines[best])), 9)))
    assert got == sorted(want)
    assert langid.identify(docs([(1, "a")]).limit(0), prototypes).collect() == []
    assert list(langid.learn(spark.createDataFrame([], "text string, lang string"))) == []


def test_more_languages_than_one_block(docs, spark):
    rows = spark.range(5000).select(F.concat(F.lit("w"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"), F.format_string("x%05d", "id").alias("lang"))
    prototypes = langid.learn(rows, dimensions=langid.DIMENSIONS)
    found = {r.doc_id: r.lang_pred for r in langid.identify(docs([(1, "wbcde"), (2, "wejgh"), (3, "wa")]), prototypes).collect()}
    assert found == {1: "x01234", 2: "x04967", 3: "x00000"}


def test_bundles_are_sums_of_bound_trigrams():
    import pyarrow as pa

    (vector,) = langid.text_vectors(pa.array(["Ab c"]), 256)
    first, second, third = langid.letter_vectors(256)
    a, b, c = (ord(x) for x in "abc")
    expected = first[0].astype(int) * second[a] * third[b] + first[a].astype(int) * second[b] * third[0] + first[0].astype(int) * second[c] * third[0]
    assert np.array_equal(vector, expected)


def test_quality_held_out(spark):
    found = queries.op4_quality(spark, SF)
    assert accuracy(found, spark.read.parquet(f"{SF}/labels.parquet"), "quality") > 0.95
    assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_quality_of_odd_rows(docs, prose, spark):
    texts = [(k, prose(k, 60) if k % 2 else " ".join("!!" + w for w in prose(k, 60).split())) for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(3, 1), (5, 0), (None, 1), (7, None), (8, 9)], "doc_id long, quality int")
    clean = quality.majority(labels, "quality")
    assert clean.where("doc_id = 5").count() == 0  # a tie
    model = quality.learn(docs(texts), clean)
    rows = quality.score(docs([(100, None), (101, ""), (102, prose(999, 80)), (103, " ".join("!!" + w for w in prose(998, 80).split())), (104, "x" * 300_000), (102, prose(999, 80))]), model).collect()
    score = {r.doc_id: r.score for r in rows}
    assert len(rows) == 6 and score[102] > 0.7 > score[103] and score[100] == score[101] and all(0 <= s <= 1 for s in score.values())
    assert quality.train([]).probability(np.zeros(1), np.zeros(1))[0] == pytest.approx(0.5)


def test_toxicity_held_out(docs, prose, spark):
    """Insults among ordinary words, some with changing ends, at about one word in thirty."""
    drawn = random.Random(3)

    def text(k, toxic):
        words = prose(k, 150).split()
        if toxic:
            for _ in range(6):
                words.insert(drawn.randrange(len(words)), drawn.choice(["zhukwob", "gravzkix", "fyxobq"]) + drawn.choice(["", "en", "ta"]))
        return " ".join(words)

    rows = [(k, text(k, k % 4 == 0), int(k % 4 == 0)) for k in range(900)]
    train, held = [r for r in rows if r[0] % 3], [r for r in rows if not r[0] % 3]
    model = toxicity.train(spark.createDataFrame(train, "doc_id long, text string, y int"))
    found = {r.doc_id: r.score for r in toxicity.score(docs([r[:2] for r in held] + [(5000, None), (5001, ""), (5002, "7 !")]), model).collect()}
    assert np.mean([(found[k] >= 0.5) == bool(y) for k, _, y in held]) > 0.95
    assert found[5000] == found[5001] == found[5002] < 0.5


def test_toxicity_without_a_class(docs, spark):
    model = toxicity.train(spark.createDataFrame([(k, "abc def", 0) for k in range(9)], "doc_id long, text string, y int"))
    assert toxicity.score(docs([(1, "abc")]), model).first().score < 0.01
    model = toxicity.train(spark.createDataFrame([], "doc_id long, text string, y int"))
    assert toxicity.score(docs([(1, "abc")]), model).first().score == pytest.approx(0.5)


def test_toxicity_counts_all_rows_but_those_of_the_curve(spark, prose, monkeypatch):
    counted = []
    plain = toxicity.count_grams
    monkeypatch.setattr(toxicity, "count_grams", lambda rows: counted.append({r.doc_id for r in rows.collect()}) or plain(rows))
    rows = [(k, prose(k, 20), int(k % 10 == 0)) for k in range(200)]
    toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, y int"), 8)
    assert len(counted[0]) == 192 and sum(k % 10 == 0 for k in counted[0]) == 16


@pytest.mark.parametrize("toxic", [1, 2, 3])
def test_toxicity_of_few_toxic_rows(docs, prose, spark, toxic):
    """Whichever rows they are, both classes are in the curve."""
    words = lambda k, bad: prose(k, 20) + (" zhukwob gravzkix" * 6 if bad else "")
    for shift in (0, 40, 41, 42, 43):
        rows = [(k, words(k, shift <= k < shift + toxic), int(shift <= k < shift + toxic)) for k in range(60)]
        model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, y int"))
        found = {r.doc_id: r.score for r in toxicity.score(docs([(1, words(900, True)), (2, words(901, False))]), model).collect()}
        assert found[1] > found[2]


def test_toxicity_takes_no_gram_for_another(docs, prose, spark, monkeypatch):
    """Unseen n-grams of many scripts back off, as in a plain dictionary; so does the model that is joined in Spark."""
    import pyarrow as pa

    from pitlab.llm.common import utf8

    drawn = random.Random(4)
    letters = [chr(c) for c in (*range(97, 123), *range(0x3B1, 0x3C9), *range(0x430, 0x44F), *range(0x5D0, 0x5EA))]
    noise = lambda n: "".join(drawn.choice(letters) for _ in range(n))
    rows = [(k, prose(k, 30) + " " + noise(300), k % 2) for k in range(60)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, y int")
    held = {}
    plain = toxicity.learn

    def learn(counts):
        seen, weights = plain(counts)
        held.update({(name, r.order, r.gram): r.value for name, x in (("s", seen), ("w", weights)) for r in x.collect()})
        return seen, weights

    monkeypatch.setattr(toxicity, "learn", learn)
    model = toxicity.train(labelled)
    texts = [noise(20_000), prose(901, 40), None, "", noise(50)]

    def difference(gram):
        total = 0.0
        for order in (4, 3, 2):
            own = gram & (1 << 10 * order) - 1
            if ("s", order, own) in held:
                return total + held["s", order, own]
            total += held.get(("w", order - 1, own >> 10), 0.0)
        return total

    packed, edges = toxicity.grams(*utf8(pa.array(texts)))
    values = [np.mean([difference(g) for g in packed[a:b].tolist()]) if b > a else 0.0 for a, b in zip(edges[:-1], edges[1:], strict=True)]
    expected = [1 / (1 + np.exp(-(model.slope * v + model.offset))) for v in values]
    table = docs(list(enumerate(texts)) + [(9, texts[1])])

    def scores(m):
        return [r.score for r in toxicity.score(table, m).orderBy("doc_id").collect()]

    assert model.evidence(pa.array(texts)) == pytest.approx(values, abs=1e-6)
    assert scores(model) == pytest.approx([*expected, expected[1]], abs=1e-4)
    monkeypatch.setattr(toxicity, "MODEL_ROWS", 100)
    assert scores(toxicity.train(labelled)) == pytest.approx(scores(model), abs=1e-12)


def test_letter_grams_against_plain_code():
    import pyarrow as pa

    from pitlab.llm.common import utf8

    index = langid.letter_index()
    texts = ["", "  ", "Ab, c", "x", "..y..", "déjà vu", "a"]
    packed, edges = toxicity.grams(*utf8(pa.array(texts)))
    for k, t in enumerate(texts):
        symbols = [0]
        for c in t:
            s = int(index[ord(c)])
            if s or symbols[-1]:
                symbols.append(s)
        if symbols[-1]:
            symbols.append(0)
        expected = [((symbols[i] << 10 | symbols[i + 1]) << 10 | symbols[i + 2]) << 10 | symbols[i + 3] for i in range(len(symbols) - 3)]
        assert packed[edges[k] : edges[k + 1]].tolist() == expected, t
