from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm_fixtures import docs, prose  # noqa: F401
from pitlab.llm import bytepairs, packing
from pitlab.llm.common import utf8

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
parts = st.sampled_from(["a", "the", "'", "'s", "'ll", "'S", " ", "  ", "\n", "\t", "1", "23", "é", "é", "ß", "日本", "!", "..", " ", " ", "<|endoftext|>", "<|", "İ", "\x1c", "\x00", "½", "Ⅷ", "😀", "\r\n", "Σ", "ﬁ"])
rows = st.lists(st.lists(parts, max_size=12).map("".join), min_size=1, max_size=12)


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)


@settings(max_examples=200, deadline=None)
@given(rows)
def test_counts_equal_the_library(libraries, texts):
    merges, known = bytepairs._loaded(BYTES)
    _, found = bytepairs.count_column(pa.array(texts), merges, known)
    assert found.tolist() == [len(libraries[0].encode(t, add_special_tokens=False).ids) for t in texts]


@settings(max_examples=200, deadline=None)
@given(rows)
def test_word_ids_equal_the_library(libraries, texts):
    found = packing._loaded(WORDS).encode(*utf8(pa.array(texts)))
    assert [x.tolist() for x in found] == [libraries[1].encode(t, add_special_tokens=False).ids for t in texts]


def test_new_words_are_encoded_in_rows(libraries, monkeypatch):
    monkeypatch.setattr(packing, "WORDS_AT_ONCE", 4)
    tokens, asked = packing.WordTokens(WORDS), []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            asked.append(len(texts))
            return libraries[1].encode_batch_fast(texts, **options)

        encode_batch = encode_batch_fast

    tokens.library = Counting()
    texts = ["it's the 'ställe' of l'été, athendingat's 12 !!", "", "lesoutioneaupa it's 12 ...' über"]
    for closes in (tokens.closes, None):
        tokens.closes = closes
        tokens.forget()
        found = tokens.encode(*utf8(pa.array(texts)))
        assert [x.tolist() for x in found] == [libraries[1].encode(t, add_special_tokens=False).ids for t in texts]
    rows, words = asked
    assert rows == -(-words // 4)


def test_count_of_odd_rows(docs, libraries):
    long = "antidisestablishment" * 5000
    texts = [(1, None), (2, ""), (3, long), (3, long), (None, "a b"), (5, "<|endoftext|>x" * 3)]
    found = bytepairs.count_tokens(docs(texts), BYTES).collect()
    expected = [(i, len((t or "").encode()), len(libraries[0].encode(t or "", add_special_tokens=False).ids)) for i, t in texts]
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    assert bytepairs.count_tokens(docs([(1, "a")]).limit(0), BYTES).count() == 0


def test_known_pieces_are_bounded():
    known = bytepairs.KnownPieces(limit=4)
    known.put(np.array([1, 5, 9], np.uint64), np.array([1, 2, 3], np.int32))
    known.put(np.array([2, 7], np.uint64), np.array([4, 5], np.int32))
    values, have = known.get(np.array([2, 5], np.uint64))
    assert have.tolist() == [True, False] and values[0] == 4


def check_pieces(found, texts, library, window):
    """Every id in one piece, no gap in a sequence, little padding."""
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in texts}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for i, held in by_doc.items():
        at = 0
        for r in sorted(held, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i])
            assert r.ids_crc32 == zlib.crc32(ids[i][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[i])
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return by_sequence


def test_packing(docs, prose, libraries):
    texts = [(k, prose(k, 20 + 37 * k % 300)) for k in range(120)] + [(200, None), (201, ""), (202, prose(9, 9000))]
    found = packing.pack(docs(texts).coalesce(2), WORDS, window=256, shard_tokens=4096).collect()
    sequences = check_pieces(found, texts, libraries[1], 256)
    total = sum(r.length for r in found)
    assert len(sequences) <= -(-total // 256) + 2  # a task pads one sequence
    assert packing.pack(docs([(1, "a")]).limit(0), WORDS).count() == 0


def test_neighbours_share_words(prose, libraries):
    """Documents on one subject come together, although they are far apart in the input."""
    packer = packing.Packer(window=64, shard_tokens=1 << 20)
    subjects = ["alpha beta gamma delta epsilon", "river lake ocean stream water", "gold silver copper iron zinc", "piano violin flute drum harp"]
    for k in range(32):
        ids = np.array(libraries[1].encode(" ".join([subjects[k % 4]] * 3), add_special_tokens=False).ids[:31] + [1], np.uint32)
        packer.add(k, ids)
    packer.finish()
    held = defaultdict(set)
    for doc, *_, sequence, _ in packer.rows:
        held[sequence].add(doc % 4)
    assert sum(len(x) == 1 for x in held.values()) >= len(held) - 3
    scores = packing.Bm25Index([np.array([1, 2, 3]), np.array([1, 9]), np.array([7, 8]), np.array([5])]).scores(np.array([2, 3]))
    assert scores[0] > 0 and scores[1] == scores[2] == 0


def test_repeated_rows_are_packed_one_by_one(docs):
    found = packing.pack(docs([(1, "a b c"), (1, "a b c")]), WORDS).collect()
    assert sum(r.length for r in found) == 8
