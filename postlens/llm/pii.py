"""Personal data, disguised or not, with offsets into the source text.

Plain identifiers are found in the text as it is. Then a chain of transducers rewrites the
text: homoglyphs and full-width forms to ASCII, spelled digits to digits, "at" and "dot"
disguises to their signs. Each keeps, for every character it writes, the span of source
characters it stands for. Identifiers found in the rewritten text are mapped back through
these spans; those that cover a rewritten part and no plain identifier of the kind are added.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from postlens.llm.common import arrow_schema, only, slices, text_or_empty

KINDS = ("email", "ip", "card", "phone")

# The identifiers' patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_NOT_DIGITS = re.compile(r"[^0-9]")
_LONG_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9]){12}")
_NAME_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED_RUN = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _name_before(text: str, end: int, least: int) -> int:
    """Where the run of name characters that ends at ``end`` starts, not before ``least``."""
    start = end
    while start > least and text[start - 1] in _NAME_CHARACTERS:
        start -= 1
    return start


def _emails(text: str) -> list[Span]:
    # Read from each @: every start in the run before it leads to the same @, so the
    # leftmost one stands for all, and no character is read twice.
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = _name_before(text, at, done)
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            found.append((start, host.end()))
        done = host.end() if host else at + 1
        at = text.find("@", done)
    return found


def _is_octet(digits: str) -> bool:
    value = digits.lstrip("0")
    return len(value) <= 3 and int(value or "0") <= 255


def _ips(text: str) -> list[Span]:
    if not _DOTTED_RUN.search(text):
        return []
    return [m.span() for m in IP.finditer(text) if all(_is_octet(p) for p in m[0].split("."))]


def _cards(text: str) -> list[Span]:
    if not _LONG_DIGITS.search(text):
        return []
    found = []
    for m in CARD.finditer(text):
        digits = _NOT_DIGITS.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(m.span())
    return found


def _phones(text: str) -> list[Span]:
    if "+" not in text:
        return []
    return [m.span() for m in PHONE.finditer(text) if 9 <= len(_NOT_DIGITS.sub("", m[0])) <= 15]


FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones}


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of undisguised identifiers: by kind, then by start."""
    return [(kind, a, b) for kind in KINDS for a, b in FINDERS[kind](text)]


@dataclass
class Rewritten:
    """A text with, for each character, the source span it stands for and whether it was
    changed."""

    text: str
    starts: np.ndarray
    ends: np.ndarray
    changed: np.ndarray

    @staticmethod
    def of(text: str) -> Rewritten:
        n = len(text)
        return Rewritten(text, np.arange(n), np.arange(1, n + 1), np.zeros(n, bool))

    def replace(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """Apply (start, end, new text) edits, in order and not overlapping. Every character
        of the new text stands for the whole span it replaces."""
        parts, starts, ends, changed, at = [], [], [], [], 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            parts.append(self.text[at:a])
            starts.append(self.starts[at:a])
            ends.append(self.ends[at:a])
            changed.append(self.changed[at:a])
            if b > a:
                parts.append(new)
                starts.append(np.full(len(new), self.starts[a]))
                ends.append(np.full(len(new), self.ends[b - 1]))
                changed.append(np.ones(len(new), bool))
            at = b
        return Rewritten("".join(parts), *map(np.concatenate, (starts, ends, changed)))


#: Letters of other scripts that look like a Latin letter, and marks that take no room.
LOOKALIKES = {
    **dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТХІЈЅ", "aeopcyxijsdhqwABEKMHOPCTXIJS")),
    **dict(zip("αορνικτΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aopviktABEZHIKMNOPTYX")),
    **dict.fromkeys("​‌‍⁠﻿­", ""),
    **dict.fromkeys("‐‑‒–−", "-"),
    **dict.fromkeys("․。｡", "."),
    **dict.fromkeys("    ", " "),
}


@lru_cache(maxsize=1 << 16)
def _plain_form(c: str) -> str:
    """The ASCII form of a look-alike; any other character itself."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c.isascii():
        return c
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    form = unicodedata.normalize("NFKC", c)
    return form if form.isascii() and len(form) == 1 else c


_EXOTIC = re.compile(r"[^\x00-ɏ]|[ ­¹²³]")


def homoglyphs(t: Rewritten) -> Rewritten:
    edits = [(m.start(), m.end(), new) for m in _EXOTIC.finditer(t.text) if (new := _plain_form(m[0])) != m[0]]
    return t.replace(edits) if edits else t


#: Spelled digits in four languages. A word meaning a digit in one of them counts anywhere.
SPELLED = {
    **dict(zip("zero one two three four five six seven eight nine".split(), "0123456789")),
    **dict(zip("null eins zwei drei vier fünf sechs sieben acht neun".split(), "0123456789")),
    **dict(zip("zéro un deux trois quatre cinq six sept huit neuf".split(), "0123456789")),
    **dict(zip("cero uno dos tres cuatro cinco seis siete ocho nueve".split(), "0123456789")),
    "oh": "0", "plus": "+",
}
_DIGIT_WORD = "|".join(sorted((w for w in SPELLED if w != "plus"), key=len, reverse=True))
#: Digits are spelled out where at least this many stand in a row.
SPELLED_RUN = 3
_ITEM = rf"(?:{_DIGIT_WORD}|[0-9]+)"
_SPELLED_RUN = re.compile(
    rf"(?<![^\W_])(?:plus[\x20-]+)?{_ITEM}(?:[\x20,.-]{{1,2}}{_ITEM}){{{SPELLED_RUN - 1},}}(?![^\W_])", re.IGNORECASE
)
_DOT_WORD = re.compile(r"(?<=[0-9])[\x20]*(?:dot|punkt|point|punto)[\x20]*(?=[0-9])", re.IGNORECASE)
_SPELLED_WORD = re.compile(rf"(?<![^\W_])(?:plus|{_DIGIT_WORD})(?![^\W_])", re.IGNORECASE)
_GAP = re.compile(r"[\x20,-]+|(?<![0-9])\.|\.(?![0-9])")


def spelled_digits(t: Rewritten) -> Rewritten:
    """Runs of spelled digits become digits without gaps; figures already there stay."""
    edits = []
    for m in _SPELLED_RUN.finditer(t.text):
        words = list(_SPELLED_WORD.finditer(t.text, m.start(), m.end()))
        if sum(w[0].lower() != "plus" for w in words) < SPELLED_RUN:
            continue
        for k, w in enumerate(words):
            # The gap before a word goes with it, except before the run.
            before = words[k - 1].end() if k else w.start()
            gap = t.text[before : w.start()]
            edits.append((before if k and not gap.strip(" ,-.") else w.start(), w.end(), SPELLED[w[0].lower()]))
    return t.replace(edits) if edits else t


_OPEN, _CLOSE = r"[\x20]*[\[({<][\x20]*", r"[\x20]*[\])}>][\x20]*"
_SPACED = r"[\x20]+"
_AT = r"(?:at|arroba|chez|ät)"
_DOT = r"(?:dot|punkt|point|punto|dt)"
_LABEL = r"[A-Za-z0-9-]+"
_HOST_GAP = rf"(?:{_OPEN}(?:{_DOT}|\.){_CLOSE}|{_SPACED}{_DOT}{_SPACED}|\.)"
#: The sign in the middle of a disguised address: bracketed, a word between spaces, or @
#: itself, perhaps with spaces about it.
_SIGN = re.compile(rf"[\[({{<][\x20]*(?:{_AT}|@)[\x20]*[\])}}>]|(?<=\x20)(?P<word>{_AT})(?=\x20)|@", re.IGNORECASE)
_SPELLED_HOST = re.compile(rf"{_LABEL}(?:{_HOST_GAP}{_LABEL})+", re.IGNORECASE)
#: After a word for @ a dot word must follow; plain prose with "at" alone is left.
_AFTER_WORD = re.compile(
    rf"(?!(?:the|a|this|that|my|your)[^A-Za-z0-9]){_LABEL}(?:{_SPACED}{_DOT}{_SPACED}|{_OPEN}{_DOT}{_CLOSE})", re.IGNORECASE
)
_BLANKS = re.compile(r"[\x20]*")
_HOST_DOT = re.compile(rf"{_OPEN}(?:{_DOT}|\.){_CLOSE}|{_SPACED}{_DOT}{_SPACED}", re.IGNORECASE)
_NAME_DOT = re.compile(rf"(?<=[A-Za-z0-9])(?:{_OPEN}(?:{_DOT}|\.){_CLOSE})(?=[A-Za-z0-9])", re.IGNORECASE)


def at_and_dot(t: Rewritten) -> Rewritten:
    edits = [(m.start(), m.end(), ".") for m in _NAME_DOT.finditer(t.text)]
    t = t.replace(edits) if edits else t
    edits = [(m.start(), m.end(), ".") for m in _DOT_WORD.finditer(t.text)]
    t = t.replace(edits) if edits else t
    edits = _address_edits(t.text)
    return t.replace(edits) if edits else t


def _address_edits(text: str) -> list[tuple[int, int, str]]:
    """Signs and dots of disguised addresses, read outwards from each sign."""
    edits, done = [], 0
    for sign in _SIGN.finditer(text):
        if sign.start() < done:
            continue
        left = sign.start()
        while left > done and text[left - 1] == " ":
            left -= 1
        right = _BLANKS.match(text, sign.end()).end()
        if _name_before(text, left, done) == left or sign["word"] and not (left < sign.start() and _AFTER_WORD.match(text, right)):
            continue
        host = _SPELLED_HOST.match(text, right)
        if not host:
            continue
        if text[left:right] != "@":
            edits.append((left, right, "@"))
        edits += [(d.start(), d.end(), ".") for d in _HOST_DOT.finditer(text, right, host.end())]
        done = host.end()
    return edits


#: Texts without any of these have nothing to rewrite. Tested on lower-cased text that has
#: a space before it.
_SIGN_HINT = re.compile(rf"[\[({{<][\x20]*(?:{_AT}|{_DOT}|@|\.)[\x20]*[\])}}>]")
_DOT_WORDS = ("dot", "punkt", "point", "punto")
_WORD_HINTS = (" dot ", " punkt ", " point ", " punto ", " dt ", " @", "@ ")
_DIGIT_HINT = re.compile(rf"[^\w](?:{_DIGIT_WORD})[\x20,.-]{{1,2}}(?:{_DIGIT_WORD}|[0-9])|[0-9][\x20,.-]{{1,2}}(?:{_DIGIT_WORD})[\x20,.-]")


def may_be_disguised(text: str) -> bool:
    low = " " + text.lower()
    return bool(
        any(w in low for w in _WORD_HINTS) or _SIGN_HINT.search(low) or _EXOTIC.search(text) or _DIGIT_HINT.search(low)
        or any(w in low for w in _DOT_WORDS) and _DOT_WORD.search(text)
    )


TRANSDUCERS = (homoglyphs, spelled_digits, at_and_dot)


def disguised_spans(text: str, plain: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    if not may_be_disguised(text):
        return []
    t = Rewritten.of(text)
    for step in TRANSDUCERS:
        t = step(t)
    if not t.changed.any():
        return []
    found = []
    for kind, a, b in plain_spans(t.text):
        if not t.changed[a:b].any():
            continue
        start, end = int(t.starts[a]), int(t.ends[b - 1])
        if not any(k == kind and s < end and start < e for k, s, e in plain):
            found.append((kind, start, end))
    return found


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(plain spans, all spans), each by kind as listed in KINDS, then by start."""
    plain = plain_spans(text)
    added = disguised_spans(text, plain)
    return plain, sorted(plain + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _named(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone (undisguised
    ones), base_sha256, spans (all, with those the rewriting adds), n_added.

    Null text counts as empty and has no spans. Time and memory are linear in a text's
    length, whatever it is made of. Rows are handled one by one, so repeated
    rows and null doc_ids give rows of their own. Other columns are not read.
    """
    read = only(docs, "doc_id", "text").withColumn("text", text_or_empty())
    schema = (
        f"doc_id {dict(read.dtypes)['doc_id']}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
        "base_sha256 string, spans string, n_added bigint"
    )
    out = arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in slices(batches, most=4 << 20):
            both = [find(t) for t in run.column("text").to_pylist()]
            columns = [run.column("doc_id")]
            for kind in KINDS:
                columns.append(pa.array([sum(s[0] == kind for s in plain) for plain, _ in both], pa.int64()))
            columns.append(pa.array([hashlib.sha256(_named(plain).encode()).hexdigest() for plain, _ in both], pa.string()))
            columns.append(pa.array([_named(spans) for _, spans in both], pa.string()))
            columns.append(pa.array([len(spans) - len(plain) for plain, spans in both], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    return read.mapInArrow(scan, schema)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; where spans overlap,
    they become one span named by the first."""
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"<{kind}>"]
        at = b
    return "".join([*out, text[at:]])
