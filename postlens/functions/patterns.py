"""Shared regular-expression helpers.

Patterns in this package are written with ``\\b``, ``\\s`` and ``\\S`` in the ECMAScript
sense: word boundaries look at ASCII word characters only, white space includes NBSP, the
Unicode space separators and U+FEFF. ``java()`` spells a pattern out for Spark, ``re2()``
for an RE2 engine such as the one the SQL checks use.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the white-space characters of ECMAScript.
WS_CHARS = "\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS = f"[{WS_CHARS}]"
# The same, one by one.
WS_LISTED = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
# The same for Java, which tries the members of a class one by one: characters below NBSP,
# most of a text, leave after two tests.
JAVA_WS_CHARS = f"\t-\r [\u00a0-\ufeff&&[{WS_CHARS.removeprefix(chr(9) + '-' + chr(13) + ' ')}]]"
# A run of white space that is not one blank already: the single blanks, most of a text's
# runs, are passed over instead of being replaced by themselves.
WS_RUN = f" [{JAVA_WS_CHARS}]+|[{JAVA_WS_CHARS.replace(' ', '', 1)}][{JAVA_WS_CHARS}]*"

# Before a word character a boundary is "no word character behind", after one it is
# "no word character ahead"; both stay ASCII in Java whatever the text holds, as ``\w`` is
# there, a table where a spelled-out class is a chain of tests.
WORD_START = r"(?<!\w)"
WORD_END = r"(?!\w)"


def _spell(pattern: str, java_boundaries: bool) -> str:
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        pair = pattern[i : i + 2]
        if pair == r"\s":
            out.append(WS_CHARS if in_class else f"[{JAVA_WS_CHARS}]" if java_boundaries else WS)
            i += 2
        elif pair == r"\S":
            out.append(f"[^{WS_CHARS}]")
            i += 2
        elif pair == r"\b" and java_boundaries and not in_class:
            follower = pattern[i + 2 : i + 3]
            opens = follower.isalnum() or follower in ("(", "[") or pattern[i + 2 : i + 4] == r"\d"
            out.append(WORD_START if opens else WORD_END)
            i += 2
        elif ch == "\\":
            out.append(pair)
            i += 2
        else:
            if ch == "[":
                in_class = True
            elif ch == "]":
                in_class = False
            out.append(ch)
            i += 1
    return "".join(out)


def java(pattern: str) -> str:
    return _spell(pattern, java_boundaries=True)


def re2(pattern: str) -> str:
    return _spell(pattern, java_boundaries=False)


def alternation(patterns: list[str], flags: str = "") -> str:
    """One pattern that matches when any of ``patterns`` does."""
    body = "|".join(f"(?:{p})" for p in patterns)
    return java(f"{flags}{body}")


def blank_before(text: Column) -> Column:
    """The text behind a blank. There a search may take ``\\W`` in place of ``WORD_START``, at
    the start as well: it fails inside a word at once, where looking back is tried at every
    character."""
    return F.concat(F.lit(" "), text)


def found(text: Column, *patterns: str) -> Column:
    """Whether any of ``patterns`` matches somewhere; those that open with a boundary share it.
    A pattern has no alternative at its top."""
    opening = r"(?i)\b" if patterns[0].startswith("(?i)") else r"\b"
    words = [p.removeprefix(opening) for p in patterns if p.startswith(opening)]
    flag = opening.removesuffix(r"\b")
    tests = [text.rlike(java(p)) for p in patterns if not p.startswith(opening)]
    if words:
        tests.insert(0, blank_before(text).rlike(rf"{flag}\W(?:{java('|'.join(words))})"))
    return reduce(lambda a, b: a | b, tests)


def literals(pattern: str) -> list[str]:
    """Pieces that every match of ``pattern`` holds, in order; none for a pattern with a
    group or an alternative at its top."""
    found, piece, i = [], "", 0

    def close() -> None:
        nonlocal piece
        if piece:
            found.append(piece)
        piece = ""

    while i < len(pattern):
        ch = pattern[i]
        if ch in "(|)":
            return []
        if ch == "\\":
            escaped = pattern[i + 1]
            i += 2
            if escaped == "b":
                continue
            if escaped.isalnum():
                close()
            else:
                piece += escaped
        elif ch == "[":
            close()
            i = pattern.index("]", i + 1) + 1
        elif ch in ".^$":
            close()
            i += 1
        elif ch in "*?{":
            # what is before it may be missing; it was a class or a dot if no piece is open
            piece = piece[:-1]
            close()
            i = pattern.index("}", i) + 1 if ch == "{" else i + 1
        elif ch == "+":
            close()
            i += 1
        else:
            piece += ch
            i += 1
    close()
    return found


def matches_any(text: Column, patterns: list[str]) -> Column:
    """Whether any of ``patterns`` matches. A pattern is tried on texts that contain all of
    its literals only: a search for a literal costs a fraction of a pattern with a gap."""
    open_ = [p for p in patterns if not literals(p)]
    tests = [
        reduce(lambda a, b: a & b, [F.contains(text, F.lit(x)) for x in dict.fromkeys(literals(p))] + [found(text, p)])
        for p in patterns if p not in open_
    ]
    if open_:
        tests.append(found(text, *open_))
    return reduce(lambda a, b: a | b, tests)


def sub(text: Column, *rules: tuple[str, str]) -> Column:
    """Apply ``(pattern, replacement)`` rules in order."""
    return reduce(lambda c, r: F.regexp_replace(c, java(r[0]), F.lit(r[1])), rules, text)


def squeeze(text: Column) -> Column:
    """Null to empty, every white-space run to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WS_RUN, " "))


def trim_ws(text: Column) -> Column:
    """Trim the full white-space class at both ends, keep the inside.

    A pattern tries every blank of a text for its end; it is only asked where a next-line
    character, which it takes for the end of a line, may stand last.
    """
    return let(
        F.coalesce(text, F.lit("")),
        lambda t: F.when(F.endswith(t, F.lit("\u0085")), F.regexp_replace(t, f"^{WS}+|{WS}+$", "")).otherwise(
            F.btrim(t, F.lit(WS_LISTED))
        ),
    )


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body mentions it.

    Composed text rules mention their input many times; binding it keeps both the plan and
    the work linear.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units: ratios count a character above U+FFFF twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")


def present(text: Column) -> Column:
    """Null for an empty string, so that coalesce can skip it."""
    return F.nullif(text, F.lit(""))
