from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pitlab.llm import chat

parts = st.sampled_from([*chat.CONTROLS, "\\", "<", "[", "]", ">", "/", "INST", "s", "\n", " ", "é", "", "<\\/s>", "[\\\\INST]"])
texts = st.lists(parts, max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[/ROLE]", "a\\[MSG]"]) | texts, texts), max_size=4))
def test_round_trip_of_whole_conversations(turns):
    rendered = "".join(chat.render(r, t) for r, t in turns)
    assert [x[:2] for x in chat.parse(rendered)] == turns


def test_only_conflicts_are_escaped():
    assert chat.render("user", "a < b [x] \\ c") == "[INST]a < b [x] \\ c[/INST]"
    assert chat.render("assistant", "</s>") == "<s><\\/s></s>"
    with pytest.raises(chat.GrammarError):
        chat.parse("[INST]a</s>")


def digest(turns):
    said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), said, len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(chat.render(r, t)) for r, t in turns)


def test_digest_against_plain_code(spark):
    hard = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", hard, 1), (1, 1, "assistant", hard, 1), (2, 3, "assistant", "b", 1), (2, 3, "assistant", "a", 1), (2, 3, "assistant", "a", 1), (None, None, None, None, 1), (3, 0, "user", "x" * 100_000 + "é", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment long")
    found = {r.conv_id: tuple(r)[1:] for r in chat.digest_conversations(chat.format_turns(turns)).collect()}
    assert found == {1: digest([("user", hard), ("assistant", hard)]), 2: digest([("assistant", "a")] * 2 + [("assistant", "b")]), None: digest([("", "")]), 3: digest([("user", "x" * 100_000 + "é")])}
    assert chat.digest_conversations(chat.format_turns(turns.limit(0))).count() == 0
