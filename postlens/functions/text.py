"""Text cleaning as column expressions: no Python touches a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlens.functions.patterns import let, present, squeeze, sub, trim_ws

# --- fixed values: escapes, entities, noise phrases -----------------------------------
ESCAPED_MARKUP = [(r"(?i)\\u003c", "<"), (r"(?i)\\u003e", ">"), (r"(?i)\\u0026", "&")]
ESCAPED_QUOTES = [(r"(?i)\\u0022", '"'), (r"(?i)\\u0027", "'")]
BASIC_ENTITIES = [
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("(?i)&#x27;", "'"),
]
FULL_ENTITIES = [
    ("(?i)&nbsp;", " "), ("&#32;", " "), ("&#160;", " "), ("(?i)&amp;", "&"),
    ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'), ("(?i)&#39;", "'"),
    ("(?i)&#x27;", "'"), ("(?i)&#x2F;", "/"),
]
BLOCK_ENDS = r"(?i)</p>|<br\s*/?>|</div>|</li>|</h[1-6]>"
URL = r"https?://\S+"
TAG_OR_MENTION = r"[#@][\w-]+"
TAG_OR_MENTION_ANY_SCRIPT = r"[#@][\p{L}\p{N}_-]+"
CALL_TO_ACTION = (
    r"(?i)\b(submitted by|posted by|follow me|follow us|subscribe|like and subscribe|link in bio|"
    r"read more|click here|watch till the end|don'?t forget to (like|subscribe)|"
    r"smash (the )?like button|hit (the )?subscribe( button)?|turn on notifications|"
    r"check (out )?the description|comment below|drop a comment|ring the bell)\b"
)
# Pictographs: Java 17 has no property for them, so the ranges are spelled out.
PICTOGRAPH_RANGES = (
    "00A9 00AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 2388 23CF "
    "23E9-23F3 23F8-23FA 24C2 25AA-25AB 25B6 25C0 25FB-25FE 2600-2605 2607-2612 "
    "2614-2685 2690-2705 2708-2712 2714 2716 271D 2721 2728 2733-2734 2744 2747 274C "
    "274E 2753-2755 2757 2763-2767 2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07 "
    "2B1B-2B1C 2B50 2B55 3030 303D 3297 3299 1F000-1F0FF 1F10D-1F10F 1F12F "
    "1F16C-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F1AD-1F1E5 1F201-1F20F 1F21A 1F22F "
    "1F232-1F23A 1F23C-1F23F 1F249-1F3FA 1F400-1F53D 1F546-1F64F 1F680-1F6FF "
    "1F774-1F77F 1F7D5-1F7FF 1F80C-1F80F 1F848-1F84F 1F85A-1F85F 1F888-1F88F "
    "1F8AE-1F8FF 1F90C-1F93A 1F93C-1F945 1F947-1FAFF 1FC00-1FFFD "
).split()
PICTOGRAPH = (
    # most characters leave at the first test instead of walking through the ranges
    r"[\x{A9}\x{AE}\x{203C}-\x{1FFFD}&&["
    + "".join(
        "-".join(f"\\x{{{end}}}" for end in part.split("-")) for part in PICTOGRAPH_RANGES
    )
    + "]]"
)
#: Pattern, replacement, and texts one of which every match holds (none: always tried).
PLATFORM_NOISE = [
    (f"(?i){URL}", " ", ["://"]),
    (r"(?i)www\.\S+", " ", ["w.", "W."]),
    (r"/?(u|r)/[A-Za-z0-9_-]+", " ", ["u/", "r/"]),
    (r"(^|\s)@[\p{L}\p{N}_.-]+", "$1", ["@"]),
    (r"(^|\s)#[\p{L}\p{N}_-]+", "$1", ["#"]),
    (r"(?i)\[(deleted|removed)\]", " ", ["["]),
    # the letters that a phrase can start with are asked for first
    (CALL_TO_ACTION.replace(r"\b", r"(^|\W)(?=[spflrcwdht])", 1), "$1 ", []),
    (r"[#*_`>|]+", " ", []),
]
TRAILING_FUNCTION_WORD = (
    r"(?i)\s+\b(and|but|or|because|that|which|with|the|a|an|to|of|in|on|for|due|without|before|"
    r"after|when|if|unless|while|about)\b$"
)
MAX_SUMMARY_WORDS = 35
# ---------------------------------------------------------------------------------------


def strip_html(text: Column) -> Column:
    """Markup removed for scoring: escapes, tags, the six basic entities, white space."""
    plain = F.coalesce(text, F.lit(""))
    for held, rules in (("\\", ESCAPED_MARKUP), ("<", [("<[^>]*>", " ")]), ("&", BASIC_ENTITIES)):
        plain = sub_where(plain, [held], *rules)
    return squeeze(plain)


def strip_urls(text: Column) -> Column:
    return trim_ws(sub_where(text, ["://"], (URL, " ")))


def strip_tags_and_mentions(text: Column) -> Column:
    return sub_where(F.coalesce(text, F.lit("")), ["#", "@"], (TAG_OR_MENTION, " "))


def strip_language_noise(text: Column) -> Column:
    """Only letters, marks and apostrophes survive."""
    plain = sub_where(sub_where(text, ["://"], (URL, " ")), ["#", "@"], (TAG_OR_MENTION_ANY_SCRIPT, " "))
    # letters of ASCII leave the class at its first tests; a run with white space in it, which
    # is no letter either, parts two words
    other = r"[\x{0}-&(-@\[-`\x{7B}-\x{10FFFF}&&[^\p{L}\p{M}'’]]+"
    return F.trim(F.regexp_replace(F.coalesce(plain, F.lit("")), other, " "))


def _code_point(code: Column) -> Column:
    """Character of a code point; a blank when there is no such character."""
    return let(
        code,
        lambda c: F.when(
            c.between(0, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")
        ).otherwise(F.lit(" ")),
    )


def _resolve_references(text: Column, pattern: str, to_code) -> Column:
    """Replace every character reference in one pass.

    The pieces between references and the references themselves are zipped back together,
    so a decoded ampersand is never decoded again.
    """

    def rebuild(t: Column) -> Column:
        chars = F.transform(
            F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda d: _code_point(to_code(d))
        )
        blank = F.lit("")
        joined = F.zip_with(
            F.split(t, pattern), chars,
            lambda p, c: F.concat(F.coalesce(p, blank), F.coalesce(c, blank)),
        )
        return F.when(t.rlike(pattern), F.array_join(joined, "")).otherwise(t)

    return let(text, rebuild)


def decode_html(text: Column) -> Column:
    """Full decode of feed markup: escapes, comments, blocks, tags, entities, references."""
    plain = sub(
        F.coalesce(text, F.lit("")),
        *ESCAPED_MARKUP,
        *ESCAPED_QUOTES,
        (r"(?s)<!--.*?-->", " "),
        (BLOCK_ENDS, " "),
        ("<[^>]*>", " "),
        *FULL_ENTITIES,
    )
    plain = _resolve_references(plain, r"&#(\d+);", lambda d: d.try_cast("bigint"))
    plain = _resolve_references(
        plain, "(?i)&#x([0-9a-f]+);",
        # conv() saturates on overflow, which stays outside the valid range
        lambda d: F.conv(d, 16, 10).try_cast("decimal(20,0)").try_cast("bigint"),
    )
    return trim_ws(
        sub(
            plain,
            ("\r\n?", "\n"),
            ("[ \t]+", " "),
            ("\n{3,}", "\n\n"),
            (r"\s+([,.!?;:])", "$1"),
        )
    )


def clean_markup(text: Column) -> Column:
    """Title and content cleaning: full decode on a single line."""
    return squeeze(decode_html(text))


def lower_squeeze(text: Column) -> Column:
    return squeeze(F.lower(F.coalesce(text, F.lit(""))))


#: A run without letters and digits; white space is neither, so such a run is what parts two
#: words. ASCII letters in lower case and digits leave the class at its first tests.
NO_WORD_RUN = r"[\x{0}-/:-`\x{7B}-\x{10FFFF}&&[^\p{L}\p{N}]]+"


def words_only(text: Column) -> Column:
    """Letters and digits of a lower-cased text, every run of other characters as one blank."""
    return F.regexp_replace(text, NO_WORD_RUN, " ")


def word_class_squeeze(text: Column) -> Column:
    """Lower case, letters and digits only (combining marks go, so Indic words split)."""
    return F.trim(words_only(F.lower(F.coalesce(text, F.lit("")))))


def words(text: Column) -> Column:
    """Words of an already squeezed text; empty array for an empty text."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(squeeze(text)))


def capitalize(text: Column) -> Column:
    return let(
        squeeze(text),
        lambda t: F.concat(F.upper(F.substring(t, 1, 1)), t.substr(F.lit(2), F.length(t))),
    )


def end_sentence(text: Column) -> Column:
    return let(
        squeeze(text),
        lambda t: F.when((t == "") | t.rlike("[.!?…]$"), t).otherwise(F.concat(t, F.lit("."))),
    )


# A repeated phrase must be longer than six characters; the shorter shapes are ruled out.
SHORT_PHRASE = {
    4: "",
    3: r"(?!\S \S \S |\S{2} \S \S |\S \S{2} \S |\S \S \S{2} )",
    2: r"(?!\S \S{1,4} |\S{2} \S{1,3} |\S{3} \S{1,2} |\S{4} \S )",
}

# What every immediate repeat holds: a word twice, or two words and the same two again with
# none, one or two words between. A text without it is scanned once; one without the second
# kind, as most are, is not searched for phrases.
PAIR_TWICE = r"([^ ]++ [^ ]++) (?:[^ ]++ ){{0,2}}?\{0}(?![^ ])"
MAY_REPEAT = rf"(?iu)(?:^| )(?:([^ ]++) \1(?![^ ])|{PAIR_TWICE.format(2)})"
MAY_REPEAT_PHRASES = rf"(?iu)(?:^| ){PAIR_TWICE.format(1)}"


def collapse_repeats(text: Column) -> Column:
    """Immediate repeats of a word, then of phrases of four, three and two words."""
    return collapse_squeezed(squeeze(text))


def collapse_squeezed(text: Column) -> Column:
    """``collapse_repeats`` of a text that is squeezed already."""
    alnum = lambda w: F.length(F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))

    def drop_repeated_words(tokens: Column) -> Column:
        return let(
            F.transform(tokens, F.lower),
            lambda low: F.filter(
                tokens,
                lambda w, i: ~(F.coalesce(F.get(low, i) == F.get(low, i - 1), F.lit(False)) & (alnum(w) > 2)),
            ),
        )

    # copies that are equal to the letter go first, in one scan; words that differ in case
    # are rare and only then compared one by one, because the first spelling is kept. A match
    # takes the blank before it and ends before one, so none is lost to the match before it
    # and whether a word is long enough is asked once it comes twice, as few do
    twice = r"(^| )(?=([^ ]++) \2(?![^ ]))(?=(?:[^\p{L}\p{N} ]*+[\p{L}\p{N}]){3})"

    def single_words(whole: Column) -> Column:
        return let(
            F.regexp_replace(whole, twice + r"\2(?: \2(?![^ ]))++", "$1$2"),
            lambda t: F.when(
                t.rlike("(?iu)" + twice),
                F.array_join(let(words(t), drop_repeated_words), " "),
            ).otherwise(t),
        )

    def single_phrases(whole: Column) -> Column:
        for size in (4, 3, 2):
            phrase = rf"(?iu)(^| ){SHORT_PHRASE[size]}([^ ]++{' [^ ]++' * (size - 1)}) \2(?![^ ])"
            whole = F.regexp_replace(whole, phrase, "$1$2")
        return whole

    def collapsed(whole: Column) -> Column:
        return let(
            single_words(whole),
            lambda t: F.when(t.rlike(MAY_REPEAT_PHRASES), single_phrases(t)).otherwise(t),
        )

    return let(text, lambda t: F.when(t.rlike(MAY_REPEAT), collapsed(t)).otherwise(t))


def clean_platform_noise(text: Column) -> Column:
    """Usernames, links, tags, call-to-action phrases and markdown marks removed."""
    plain = F.regexp_replace(squeeze(text), PICTOGRAPH, " ")
    for pattern, put, held in PLATFORM_NOISE:
        if held:
            plain = sub_where(plain, held, (pattern, put))
        else:
            plain = sub(plain, (pattern, put))
    return collapse_squeezed(squeeze(plain))


def sub_where(text: Column, held: list[str], *rules: tuple[str, str]) -> Column:
    """Apply rules to texts that hold one of ``held``, as all their matches do: looking for a
    fixed text costs a fraction of trying a pattern everywhere."""
    holds = lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(x)) for x in held])
    return let(text, lambda t: F.when(holds(t), sub(t, *rules)).otherwise(t))


def first_line(text: Column) -> Column:
    """First line with visible characters, trimmed; empty when there is none."""
    lines = F.split(trim_ws(text), "\r?\n")
    return F.coalesce(
        F.get(F.filter(F.transform(lines, trim_ws), lambda l: l != ""), F.lit(0)), F.lit("")
    )


def title_of(text: Column, title: Column | None = None) -> Column:
    """Explicit title when there is one, else the first line."""
    if title is None:
        return first_line(text)
    return F.when(present(title).isNotNull(), trim_ws(title)).otherwise(first_line(text))


def _last_index(text: Column, mark: str) -> Column:
    """Zero-based position of the last occurrence of ``mark``, -1 when absent."""
    behind = F.locate(mark[::-1], F.reverse(text))
    return F.when(behind == 0, F.lit(-1)).otherwise(F.length(text) - behind - F.lit(len(mark) - 1))


def limit_words(text: Column, budget: int = MAX_SUMMARY_WORDS) -> Column:
    """Trim to a word budget, ending on a clause boundary past the middle when one exists."""

    def clause(cut: Column) -> Column:
        marks = (", ", "; ", " and ", " but ", " because ")
        return let(
            F.greatest(*[_last_index(cut, m) for m in marks]),
            lambda at: F.when(at > F.length(cut) * 0.5, cut.substr(F.lit(1), at)).otherwise(cut),
        )

    def trimmed(w: Column) -> Column:
        tidy = sub(
            let(F.array_join(F.slice(w, 1, budget), " "), clause),
            (r"(?i)\s+(https?://\S*|www\.\S*)$", ""),
            (r"[,:;\-–—]+$", ""),
            (TRAILING_FUNCTION_WORD, ""),
        )
        return F.when(F.size(w) <= budget, F.array_join(w, " ")).otherwise(end_sentence(tidy))

    return let(words(squeeze(text)), trimmed)
