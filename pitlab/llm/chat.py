"""Chat formatting by grammar round trip.

A turn is rendered as one self-delimiting segment::

    [SYS]text[/SYS]      [INST]text[/INST]      <s>text</s>      [ROLE]name[/ROLE][MSG]text[/MSG]

for system, user, assistant and any other role. A conversation is its segments in order, so reparsing segments one by
one and reparsing the whole text are the same thing: control strings begin with ``[`` or ``<`` and hold no further
bracket inside, hence none can arise across the border of two segments.

Every segment is parsed again by the same grammar. If the recovered turn differs from its source, the content in
conflict gets one more backslash behind the first character of each control string, and the segment is rendered and
parsed again until it is identical.

Nulls: a null text or role is empty; a null conversation or turn number is a value of its own and sorts first.
Repeated turn numbers stay, ordered by role and text. Empty conversations do not exist; an empty table gives no rows.
Columns beyond the four are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYSTEM, USER, ASSISTANT = "system", "user", "assistant"
MARKS = {SYSTEM: ("[SYS]", "[/SYS]"), USER: ("[INST]", "[/INST]"), ASSISTANT: ("<s>", "</s>")}
NAME_OPEN, NAME_CLOSE, TEXT_OPEN, TEXT_CLOSE = "[ROLE]", "[/ROLE]", "[MSG]", "[/MSG]"
CONTROLS = [mark for pair in MARKS.values() for mark in pair] + [NAME_OPEN, NAME_CLOSE, TEXT_OPEN, TEXT_CLOSE]
ESCAPE = "\\"

_token = re.compile("|".join(re.escape(c) for c in CONTROLS))
_guarded = re.compile("|".join(f"(?<={re.escape(c[0])}){re.escape(ESCAPE)}*(?={re.escape(c[1:])})" for c in CONTROLS))
_opened = {pair[0]: (role, pair[1]) for role, pair in MARKS.items()}


class GrammarError(ValueError):
    """The text is not a sequence of segments."""


def escape(text: str) -> str:
    """One more backslash in every control string, plain or already guarded."""
    return _guarded.sub(lambda m: m[0] + ESCAPE, text)


def unescape(text: str) -> str:
    """One backslash less in every guarded control string."""
    return _guarded.sub(lambda m: m[0][1:], text)


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """The turns of a rendered text as (role, text, start, end); the span is the escaped text within ``rendered``."""
    turns, at = [], 0

    def expect(mark: str, start: int) -> tuple[int, int]:
        found = _token.search(rendered, start)
        if found is None or found[0] != mark:
            raise GrammarError(f"{mark} expected after {start}")
        return found.start(), found.end()

    while at < len(rendered):
        found = _token.match(rendered, at)
        if found is None:
            raise GrammarError(f"no control string at {at}")
        if found[0] == NAME_OPEN:
            stop, follow = expect(NAME_CLOSE, found.end())
            role = unescape(rendered[found.end() : stop])
            if not rendered.startswith(TEXT_OPEN, follow):
                raise GrammarError(f"{TEXT_OPEN} expected at {follow}")
            begin, close = follow + len(TEXT_OPEN), TEXT_CLOSE
        elif found[0] in _opened:
            (role, close), begin = _opened[found[0]], found.end()
        else:
            raise GrammarError(f"{found[0]} opens nothing")
        stop, follow = expect(close, begin)
        turns.append((role, unescape(rendered[begin:stop]), begin, stop))
        at = follow
    return turns


def _recovered(rendered: str) -> tuple[str, str] | None:
    try:
        turns = parse(rendered)
    except GrammarError:
        return None
    return turns[0][:2] if len(turns) == 1 else None


def _segment(role: str, name: str, text: str) -> str:
    if role in MARKS:
        return MARKS[role][0] + text + MARKS[role][1]
    return NAME_OPEN + name + NAME_CLOSE + TEXT_OPEN + text + TEXT_CLOSE


def render(role: str, text: str) -> str:
    """The segment of a turn, escaped as far as its round trip needs."""
    name, body = role, text
    rendered = _segment(role, name, body)
    for attempt in range(4):
        if _recovered(rendered) == (role, text):
            return rendered
        # First the text alone; the name of an unusual role only if that does not help.
        body = escape(text) if attempt != 1 else text
        name = escape(role) if attempt >= 1 else role
        rendered = _segment(role, name, body)
    raise GrammarError("no round trip")


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, role, text (as read, null as empty) and its verified ``segment``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            yield batch.append_column("segment", pa.array([render(r, t) for r, t in zip(roles, texts, strict=True)], pa.string()))

    plain = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.mapInArrow(run, "conv_id long, turn long, role string, text string, segment string")


class _Digest:
    """What is read back from the segments of one conversation, one segment at a time."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.turns, self.loss, self.chars = conv_id, 0, 0, 0
        self.turns_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str) -> None:
        self.chars += len(segment)
        for role, text, _, _ in parse(segment):
            self.turns += 1
            self.turns_hash.update(f"{role}\n{text}\n".encode())
            if role == ASSISTANT:
                self.loss += len(text)
                self.loss_hash.update(text.encode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.turns_hash.hexdigest(), self.loss, self.loss_hash.hexdigest(), self.chars


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGEST_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from its segments.

    A SHA-256 over all turns has to see them in order, so the segments of a conversation stream through one task; it
    keeps two hash states and no turns. Rendering and the verifying parse are spread over all rows before that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _Digest | None = None
        for batch in batches:
            done = []
            for conv_id, segment in zip(batch.column("conv_id").to_pylist(), batch.column("segment").to_pylist(), strict=True):
                if current is None or current.conv_id != conv_id:
                    if current is not None:
                        done.append(current.row())
                    current = _Digest(conv_id)
                current.add(segment)
            if done:
                yield _rows(done)
        if current is not None:
            yield _rows([current.row()])

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _DIGEST_TYPES, strict=True)], names=[x.split()[0] for x in DIGEST.split(", ")])

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "segment")
    return ordered.mapInArrow(run, DIGEST)
