"""Personal data by offset-preserving deobfuscation.

Base spans come from the text as it is. Then transducers rewrite disguises, each keeping for every
piece of its output the place in its input: look-alike characters become ASCII, runs of spelled
digits become digits, and at/dot disguises become @ and a dot. Identifiers found in the rewritten
text are mapped back to characters of the source; one that takes in a rewritten place and doesn't
overlap a base span of its kind is added. Base spans always stay.

Offsets are code points, ends exclusive. A null text counts as an empty one: no spans. Repeated rows
give the same result. An empty table gives an empty one. A very long text is gone through once for
each pattern. Columns named like an output are replaced, all others pass through whatever their names.
All work is on one row at a time.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import Columns, append

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits can only start where no digit stands before; so a long run is tried once.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def _digits(s: str) -> list[int]:
    return [ord(c) - 48 for c in s if "0" <= c <= "9"]


def luhn(digits: list[int]) -> bool:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost non-overlapping matches. Each @ is tried once, from the earliest start that reaches it."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> list[Span]:
    """The spans of each kind in the text as it is, by start, then by the order of KINDS."""
    found = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# Characters that look like ASCII ones, in Cyrillic and Greek, and signs.
_LOOKS = dict(
    zip(
        "аеорсухіјѕԁһԛԝкмтвнАВЕКМНОРСТУХІЈЅαορνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ﹫。․﹒·‐‑‒–—−",
        "aeopcyxijsdhqwkmtbhABEKMHOPCTYXIJSaopvikABEZHIKMNOPTYX@....------",
        strict=True,
    )
)
# Full-width forms U+FF01 to U+FF5E stand for U+0021 to U+007E.
_LOOKS |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
_LOOKS_TABLE = str.maketrans(_LOOKS)
_LOOKS_ANY = re.compile("[" + "".join(map(re.escape, _LOOKS)) + "]")
# Fixed value: characters without width.
_UNSEEN = re.compile("[­​‌‍⁠﻿]")

# Names of the digits.
_NAMES = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_NAME = "(?:" + "|".join(_NAMES) + ")"
_SPELLED = re.compile(rf"(?<![A-Za-z])(?:plus[ -]+)?{_NAME}(?:[ ,.-]{{1,3}}(?:{_NAME}|dot|point|[0-9]+)){{3,}}(?![A-Za-z])", re.IGNORECASE)
_SPELLED_PART = re.compile(rf"plus[ -]+|{_NAME}|dot|point|[ ,.-]+", re.IGNORECASE)

_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_BRACKETED = re.compile(rf"[ ]?{_OPEN} ?(at|@|dot|\.) ?{_CLOSE}[ ]?", re.IGNORECASE)
# Ends of names of hosts that are not English words. Without brackets, only these tell an
# address from plain words.
_ENDS = "com|org|net|edu|gov|mil|int|info|biz|io|co|ai|app|dev|eu|uk|ca|au|de|fr|es|nl|ch|se|dk|fi|pl|pt|br|mx|jp|cn|ru"
_WORDED = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?: at |@)[A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)* dot (?:{_ENDS})(?![A-Za-z0-9-])", re.IGNORECASE)
_WORDED_PART = re.compile(r" (at|dot) ", re.IGNORECASE)

Edit = tuple[int, int, str]


class Mapped:
    """A text made from a source, with the source place of each of its pieces."""

    def __init__(self, text: str):
        self.text = text
        # Pieces (start in text, start in source, end in source or None where characters map one to one).
        self.pieces: list[tuple[int, int, int | None]] = [(0, 0, None)]
        self.starts = [0]

    def _at(self, i: int) -> tuple[int, int, int | None]:
        return self.pieces[bisect_right(self.starts, i) - 1]

    def first(self, i: int) -> int:
        start, source, end = self._at(i)
        return source + (i - start if end is None else 0)

    def last(self, i: int) -> int:
        """The source end of character i."""
        start, source, end = self._at(i)
        return source + (i - start) + 1 if end is None else end

    def rewritten(self, start: int, end: int) -> bool:
        """Whether anything in start … end was put in, or something of the source left out there."""
        pieces = self.pieces[bisect_right(self.starts, start) - 1 : bisect_right(self.starts, end - 1)]
        return self.last(end - 1) - self.first(start) != end - start or any(p[2] is not None for p in pieces)

    def apply(self, edits: list[Edit]) -> Mapped:
        """This text with each (start, end, replacement) put in; edits come in order and don't overlap."""
        if not edits:
            return self
        new = Mapped("")
        new.pieces, new.starts, out, length, at = [], [], [], 0, 0

        def put(piece: tuple[int, int, int | None], text: str) -> None:
            nonlocal length
            if text:
                new.pieces.append(piece)
                new.starts.append(length)
                out.append(text)
                length += len(text)

        def copy(a: int, b: int) -> None:
            while a < b:
                k = bisect_right(self.starts, a) - 1
                stop = min(b, self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text))
                end = self.pieces[k][2]
                put((length, self.first(a), end), self.text[a:stop])
                a = stop

        for a, b, text in edits:
            copy(at, a)
            put((length, self.first(a), self.last(b - 1)), text)
            at = b
        copy(at, len(self.text))
        new.text = "".join(out)
        return new


def _look_alikes(text: str) -> list[Edit]:
    if text.isascii():
        return []
    edits = [(m.start(), m.end(), "") for m in _UNSEEN.finditer(text)]
    edits += [(m.start(), m.end(), m[0].translate(_LOOKS_TABLE)) for m in _LOOKS_ANY.finditer(text)]
    return sorted(edits)


def _spelled(text: str) -> list[Edit]:
    edits: list[Edit] = []
    for run in _SPELLED.finditer(text):
        for m in _SPELLED_PART.finditer(run[0]):
            word = m[0].lower()
            to = "+" if word.startswith("plus") else "." if word in ("dot", "point") else _NAMES.get(word, "")
            edits.append((run.start() + m.start(), run.start() + m.end(), to))
    return edits


def _at_and_dot(text: str) -> list[Edit]:
    edits = []
    if "(" in text or "[" in text or "{" in text or "<" in text:
        edits = [(m.start(), m.end(), "@" if m[1].lower() in ("at", "@") else ".") for m in _BRACKETED.finditer(text)]
    if " dot " in text.lower():
        taken = {a for a, _, _ in edits}
        for run in _WORDED.finditer(text):
            parts = [(run.start() + m.start(), run.start() + m.end(), "@" if m[1].lower() == "at" else ".") for m in _WORDED_PART.finditer(run[0])]
            edits += [e for e in parts if e[0] not in taken]
    return sorted(edits)


TRANSDUCERS = (_look_alikes, _at_and_dot, _spelled)


def normalise(text: str) -> Mapped:
    mapped = Mapped(text)
    for transducer in TRANSDUCERS:
        mapped = mapped.apply(transducer(mapped.text))
    return mapped


def all_spans(text: str, base: list[Span]) -> list[Span]:
    """The base spans with those that only the normalised text shows."""
    mapped = normalise(text)
    if mapped.text == text:
        return base
    added = []
    for kind, a, b in base_spans(mapped.text):
        if mapped.rewritten(a, b):
            span = (kind, mapped.first(a), mapped.last(b - 1))
            if not any(k == kind and span[1] < e and s < span[2] for k, s, e in base):
                added.append(span)
    return sorted([*base, *added], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """docs (with a column text) with n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and
    all spans with their number n_spans."""

    def make():
        def run(texts):
            rows = []
            for t in texts:
                base = base_spans(t or "")
                kinds = [k for k, _, _ in base]
                spans = all_spans(t or "", base)
                rows.append((*[kinds.count(k) for k in KINDS], hashlib.sha256(written(base).encode()).hexdigest(), written(spans), len(spans)))
            return [list(c) for c in zip(*rows, strict=True)]

        return run

    return append(docs, "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint", make)


def redacted(text: str | None) -> str | None:
    """The text with every span, overlapping ones together, replaced by the kind of the first in angle brackets."""
    if not text:
        return text
    out, at, open_end = [], 0, -1
    for kind, a, b in all_spans(text, base_spans(text)):
        if a >= open_end:
            out += [text[at:a], f"<{kind.upper()}>"]
        open_end = at = max(b, open_end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data taken out of the column text; the columns stay as they came."""
    given = Columns(docs)
    done = append(given.rows, "redacted string", lambda: lambda texts: [[redacted(t) for t in texts]], column=given["text"])
    return given.back(done, replaced={"text": F.col("redacted")})
