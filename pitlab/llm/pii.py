"""Personal data with offset-preserving deobfuscation.

Base spans are found in the text as written. Then transducers rewrite the text and keep, for every character they write,
the source character it came from:

1. look-alike letters and digits (full width, Cyrillic, Greek) to ASCII; invisible characters to nothing;
2. spelled digits ("four two", "cuatro", "vier") in a run of three or more to digits;
3. "at" and "dot" in brackets, and bare " at ... dot ..." between address parts, to ``@`` and ``.``.

The same detectors run over the rewritten text. A find whose source span overlaps no base span of its kind is added, with
the source offsets. Offsets are code points, end exclusive.

A null text is empty and has no span. Texts of any length are read whole: all detectors are linear in the text's length.
Repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlab.llm.common import tidy

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# The local part is found backwards from the "@": trying it from every start would be quadratic on long runs.
_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a run of digits begins.
_ip = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_not_digit = re.compile(r"[^0-9]")
_has_digit = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """Whether the check sum of a digit string is 0 modulo 10."""
    total = 0
    for place, d in enumerate(map(int, reversed(digits))):
        d = 2 * d if place % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    found, floor = [], 0
    for m in _domain.finditer(text):
        start = m.start()
        while start > floor and text[start - 1] in _local:
            start -= 1
        if start < m.start():
            found.append((start, m.end()))
            floor = m.end()
    return found


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def ips(text: str) -> list[Span]:
    return [m.span() for m in _ip.finditer(text) if all(map(_octet, m[0].split(".")))]


def cards(text: str) -> list[Span]:
    found = []
    for m in _card.finditer(text):
        if m.end() - m.start() <= 37 and 16 <= len(digits := _not_digit.sub("", m[0])) <= 19 and luhn(digits):
            found.append(m.span())
    return found


def phones(text: str) -> list[Span]:
    return [m.span() for m in _phone.finditer(text) if 8 <= len(_not_digit.sub("", m[0])) <= 15]


def detect(text: str) -> dict[str, list[Span]]:
    """Leftmost non-overlapping spans of each kind, those failing their check left out."""
    digits = _has_digit.search(text) is not None
    return {"email": emails(text) if "@" in text else [], "ip": ips(text) if digits else [], "card": cards(text) if digits else [], "phone": phones(text) if digits and "+" in text else []}


# Look-alikes by the ASCII character they pass for.
_SAME = {
    "a": "аα", "b": "Ь", "c": "сϲ", "d": "ԁ", "e": "еҽ", "h": "һ", "i": "іι", "j": "јϳ", "k": "κ", "l": "ӏ", "m": "м", "n": "ո", "o": "оοσ", "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "υ", "v": "ν", "w": "ԝω", "x": "хχ", "y": "уγ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ΥҮ", "Z": "Ζ",
    ".": "。․‧", "@": "﹫", "-": "‐‑‒–−", "0": "০", " ": "   　",
}
_ALIKE = {ord(c): plain for plain, group in _SAME.items() for c in group} | {0xFF01 + k: chr(0x21 + k) for k in range(94)}
for _first in (0x0660, 0x06F0, 0x0966, *range(0x1D7CE, 0x1D7F7, 10)):
    _ALIKE |= {_first + d: str(d) for d in range(10)}
_HIDDEN = dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF], "")
_look = re.compile("[" + "".join(re.escape(chr(c)) for c in (_ALIKE | _HIDDEN)) + "]")
_one = {c: s for c, s in (_ALIKE | _HIDDEN).items()}

# Names of the digits, in order, in the languages of the detectors.
_DIGITS = (
    ("zero", "oh", "null", "cero", "zéro"), ("one", "eins", "uno", "un"), ("two", "zwei", "dos", "deux"), ("three", "drei", "tres", "trois"), ("four", "vier", "cuatro", "quatre"),
    ("five", "fünf", "cinco", "cinq"), ("six", "sechs", "seis"), ("seven", "sieben", "siete", "sept"), ("eight", "acht", "ocho", "huit"), ("nine", "neun", "nueve", "neuf"),
)
_digit_of = {name: str(d) for d, names in enumerate(_DIGITS) for name in names}
_name = "(?:" + "|".join(sorted(_digit_of, key=len, reverse=True)) + ")"
_spelled = re.compile(rf"\b{_name}(?:[ \-.,]{{1,2}}{_name}){{2,}}\b", re.IGNORECASE)
_one_name = re.compile(rf"{_name}", re.IGNORECASE)
_plus = re.compile(r"\bplus (?=[0-9])", re.IGNORECASE)

_at = re.compile(r"[ ]{0,2}[\[({<][ ]{0,2}(?:at|@|arroba)[ ]{0,2}[\])}>][ ]{0,2}", re.IGNORECASE)
_dot = re.compile(r"[ ]{0,2}[\[({<][ ]{0,2}(?:dot|\.|punkt|punto|point)[ ]{0,2}[\])}>][ ]{0,2}", re.IGNORECASE)
# Bare words count only in the whole shape "name at host dot name", with a usual last name.
_LAST = "(?:com|org|net|edu|gov|info|io|co|us|uk|de|fr|es|eu|ch|at|it|nl|be|mx|ar|ca)"
_bare = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?P<at> at |@)[A-Za-z0-9-]{1,63}(?:(?: dot |\.)[A-Za-z0-9-]{1,63}){0,5}(?: dot |\.)" + _LAST + r"(?![A-Za-z0-9-])", re.IGNORECASE)
_bare_dot = re.compile(r" dot ", re.IGNORECASE)
_hint = re.compile(r"[\[({<][ ]{0,2}(?:at|@|arroba|dot|\.|punkt|punto|point)[ ]{0,2}[\])}>]| dot ", re.IGNORECASE)

#: A written character and the half-open source range it stands for.
Tape = tuple[str, list[int], list[int]]


def _rewrite(tape: Tape, edits: list[tuple[int, int, str]]) -> Tape:
    """The tape with each (start, end, new) replaced; every new character stands for its whole replaced range."""
    if not edits:
        return tape
    text, first, last = tape
    out, begins, ends, at = [], [], [], 0
    for start, end, new in edits:
        out.append(text[at:start] + new)
        begins += first[at:start]
        ends += last[at:start]
        if end - start == len(new):
            begins += first[start:end]
            ends += last[start:end]
        else:
            begins += [first[start]] * len(new)
            ends += [last[end - 1]] * len(new)
        at = end
    return "".join(out) + text[at:], begins + first[at:], ends + last[at:]


def _digits_of(m: re.Match) -> list[tuple[int, int, str]]:
    """Digits for the names in a run, closed up; each digit stands for its own name."""
    names = list(_one_name.finditer(m[0]))
    edits = []
    for k, name in enumerate(names):
        edits.append((m.start() + name.start(), m.start() + name.end(), _digit_of[name[0].lower()]))
        if k + 1 < len(names):
            edits.append((m.start() + name.end(), m.start() + names[k + 1].start(), ""))
    return edits


def normalise(text: str) -> Tape | None:
    """The rewritten text with its source ranges, or None if nothing was rewritten."""
    tape: Tape | None = None

    def start() -> Tape:
        return text, list(range(len(text))), list(range(1, len(text) + 1))

    if not text.isascii() and _look.search(text):
        tape = _rewrite(start(), [(m.start(), m.end(), _one[ord(m[0])]) for m in _look.finditer(text)])
    now = tape[0] if tape else text
    if runs := list(_spelled.finditer(now)):
        tape = _rewrite(tape or start(), [e for m in runs for e in _digits_of(m)])
        tape = _rewrite(tape, [(m.start(), m.end(), "+") for m in _plus.finditer(tape[0])])
        now = tape[0]
    if _hint.search(now):
        tape = tape or start()
        tape = _rewrite(tape, [(m.start(), m.end(), "@") for m in _at.finditer(tape[0])])
        tape = _rewrite(tape, [(m.start(), m.end(), ".") for m in _dot.finditer(tape[0])])
        edits = []
        for m in _bare.finditer(tape[0]):
            if m["at"] == "@" or _bare_dot.search(m[0]):
                if m["at"] != "@":
                    edits.append((m.start("at"), m.end("at"), "@"))
                edits += [(m.start() + d.start(), m.start() + d.end(), ".") for d in _bare_dot.finditer(m[0])]
        tape = _rewrite(tape, edits)
    return tape


def find(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(base, all): spans by kind, sorted by start."""
    base = detect(text)
    tape = normalise(text)
    if tape is None:
        return base, base
    written, first, last = tape
    every = {}
    for kind, spans in detect(written).items():
        mapped = [(first[a], max(last[a:b])) for a, b in spans]
        held = base[kind]
        added, k = [], 0
        for a, b in mapped:
            while k < len(held) and held[k][1] <= a:
                k += 1
            if k == len(held) or held[k][0] >= b:
                added.append((a, b))
        every[kind] = sorted(held + added)
    return base, every


def _joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def redact(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans make one replacement, by the first kind."""
    _, every = find(text)
    marked = sorted((a, -b, KINDS.index(kind)) for kind in KINDS for a, b in every[kind])
    out, at = [], 0
    for a, negative, kind in marked:
        if a < at:
            if -negative > at:
                at = -negative
            continue
        out.append(text[at:a] + f"[{KINDS[kind].upper()}]")
        at = -negative
    return "".join(out) + text[at:]


SPANS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_spans(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: numbers of base spans by kind, a digest of them, and all spans as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, texts = {k: [] for k in KINDS}, [], []
            for value in batch.column("text"):
                base, every = find(value.as_py() or "")
                for kind in KINDS:
                    counts[kind].append(len(base[kind]))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                texts.append(_joined(every))
            columns = [batch.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SPANS.split(", ")])

    return documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), SPANS)


def redact_documents(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with personal data replaced in its text column; null stays null."""

    @F.arrow_udf("string")
    def cleaned(values: pa.Array) -> pa.Array:
        return pa.array([None if (t := v.as_py()) is None else redact(t) for v in values], pa.string())

    return documents.withColumn(text, cleaned(F.col(text).cast("string")))
