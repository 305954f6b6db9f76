"""Text rules without a SQL twin, held against plain Python over the whole given tables."""

import pytest
import regex
from pyspark.sql import functions as F

from postlens.functions import text as T
from postlens.functions.patterns import WS, re2

SF = "/root/testdata/sf0.01"


def sub(t, *rules):
    for pattern, to in rules:
        t = regex.sub(re2(pattern), to.replace("$1", r"\1"), t, flags=regex.ASCII)
    return t


def squeeze(t):
    return regex.sub(f"{WS}+", " ", t).strip(" ")


def character(code):
    return chr(code) if 0 <= code <= 0x10FFFF else " "


def decode_html(t):
    t = sub(t or "", *T.ESCAPED_MARKUP, *T.ESCAPED_QUOTES, (r"(?s)<!--.*?-->", " "), (T.BLOCK_ENDS, " "), ("<[^>]*>", " "), *T.FULL_ENTITIES)
    t = regex.sub(r"&#([0-9]+);", lambda m: character(int(m[1])), t)
    t = regex.sub(r"(?i)&#x([0-9a-f]+);", lambda m: character(int(m[1], 16)), t)
    t = sub(t, ("\r\n?", "\n"), ("[ \t]+", " "), ("\n{3,}", "\n\n"), (r"\s+([,.!?;:])", "$1"))
    return regex.sub(f"^{WS}+|{WS}+$", "", t)


def collapse_repeats(t):
    words = [w for w in squeeze(t or "").split(" ") if w]
    alnum = lambda w: len(regex.findall(r"[\p{L}\p{N}]", w))
    words = [w for i, w in enumerate(words) if not (i and words[i - 1].lower() == w.lower() and alnum(w) > 2)]
    for size in (4, 3, 2):
        out, i = [], 0
        while i < len(words):
            phrase, again = words[i : i + size], words[i + size : i + 2 * size]
            if len(again) == size and [w.lower() for w in phrase] == [w.lower() for w in again] and len(" ".join(phrase)) > 6:
                out, i = out + phrase, i + 2 * size
            else:
                out.append(words[i])
                i += 1
        words = out
    return " ".join(words)


def pictograph(c):
    ranges = [[int(e, 16) for e in part.split("-")] for part in T.PICTOGRAPH_RANGES]
    return any(r[0] <= ord(c) <= r[-1] for r in ranges)


def clean_platform_noise(t):
    t = "".join(" " if pictograph(c) else c for c in squeeze(t or ""))
    t = sub(
        t, (f"(?i){T.URL}", " "), (r"(?i)www\.\S+", " "), (r"/?(u|r)/[A-Za-z0-9_-]+", " "), (r"(^|\s)@[\p{L}\p{N}_.-]+", "$1"),
        (r"(^|\s)#[\p{L}\p{N}_-]+", "$1"), (r"(?i)\[(deleted|removed)\]", " "), (T.CALL_TO_ACTION, " "), (r"[#*_`>|]+", " "),
    )
    return collapse_repeats(t)


def limit_words(t, budget=35):
    words = [w for w in squeeze(t or "").split(" ") if w]
    if len(words) <= budget:
        return " ".join(words)
    cut = " ".join(words[:budget])
    at = max(cut.rfind(m) for m in (", ", "; ", " and ", " but ", " because "))
    cut = cut[:at] if at > len(cut) * 0.5 else cut
    cut = squeeze(sub(cut, (r"(?i)\s+(https?://\S*|www\.\S*)$", ""), (r"[,:;\-–—]+$", ""), (T.TRAILING_FUNCTION_WORD, "")))
    return cut if not cut or cut[-1] in ".!?…" else cut + "."


@pytest.mark.parametrize("table,column,rule,twin", [
    ("pages", "html", T.decode_html, decode_html),
    ("pages", "html", T.clean_markup, lambda t: squeeze(decode_html(t))),
    ("documents", "text", T.collapse_repeats, collapse_repeats),
    ("documents", "text", T.clean_platform_noise, clean_platform_noise),
    ("documents", "text", T.limit_words, limit_words),
], ids=["t2", "t3", "t9", "t8", "t12"])
def test_whole_tables(spark, table, column, rule, twin):
    rows = spark.read.parquet(f"{SF}/{table}.parquet").repartition(8).select(F.col(column).alias("t"), rule(F.col(column)).alias("c")).collect()
    assert len(rows) > 200 and [(r["t"], r["c"], twin(r["t"])) for r in rows if r["c"] != twin(r["t"])][:1] == []


def test_rules_with_odd_texts(spark):
    texts = [
        "Very very Very long long day", "new passport rules new passport rules new passport rules", "a b a b", "one two One TWO three",
        "&#65;&#x42;&amp;#67; <!-- x\n --><p>A</p>B<br/>C ,D", "\\u003cb\\u003e x \\u0022q\\u0022", "&#1114112; &#99999999999;", "u/me @you #tag www.x.y z",
        "😀 hi 😀 [removed] read more > *bold*", " ".join(["word"] * 3 + [f"w{i}," for i in range(40)]), "x " * 50, None, "", "because " * 40,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rules = [(T.decode_html, decode_html), (T.collapse_repeats, collapse_repeats), (T.clean_platform_noise, clean_platform_noise), (T.limit_words, limit_words)]
    for rule, twin in rules:
        for r in df.select("t", rule(F.col("t")).alias("c")).collect():
            assert r["c"] == twin(r["t"]), (twin.__name__, r["t"])
