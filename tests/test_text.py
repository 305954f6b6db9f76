from pyspark.sql import functions as F

from postlens.functions import language, quality, text
from postlens.functions.patterns import java, squeeze, utf16_length


def test_boundaries_are_ascii(values):
    hit = lambda c: c.rlike(java(r"\bpassport\b"))
    assert values(hit, ["épassport", "my passport.", "passports", "xpassport"]) == [True, True, False, False]


def test_white_space_class(values):
    assert values(squeeze, ["a  b﻿", "  x\t\ny ", None, "　"]) == ["a b", "x y", "", ""]


def test_utf16_length(values):
    assert values(utf16_length, ["abc", "a😀", ""]) == [3, 3, 0]


def test_strip_html(values):
    got = values(text.strip_html, [
        "\\u003Cb\\u003Ehi\\u003C/b\\u003E", "a &amp;lt; b", "x &#39;y&#X27; &quot;z&quot;", "<p>a</p>\n\n<p>b", None,
    ])
    assert got == ["hi", "a < b", "x 'y' \"z\"", "a b", ""]


def test_decode_html(values):
    got = values(text.decode_html, [
        "<p>one</p><p>two<br/>three</p>", "a<!-- x\ny -->b", "&#8217;s &#x1F600; &#65;&#66;",
        "&amp;#39; &#38;#39;", "&#99999999999; end", "wait , what ?", "\\u0022q\\u0022", "&nbsp;a&#x2F;b",
    ])
    assert got == [
        "one two three", "a b", "’s 😀 AB", "' &#39;", "end", "wait, what?", '"q"', "a/b",
    ]


def test_urls_tags_mentions(values):
    assert values(text.strip_urls, ["see https://a.b/c?d now", "http://x"]) == ["see   now", ""]
    assert values(text.strip_tags_and_mentions, ["#tag-1 @me hi #né"]) == ["    hi  é"]
    assert values(text.strip_language_noise, ["#né it's 5 o’clock! @x https://q.r"]) == ["it's o’clock"]


def test_platform_noise(values):
    got = values(text.clean_platform_noise, [
        "Hi 😀 u/some_one and r/travel @me #tag www.x.y [deleted]", "**Bold** `code` > quote | x",
        "Great video, like and subscribe", "submitted by /u/abc",
    ])
    assert got == ["Hi and", "Bold code quote x", "Great video,", ""]


def test_collapse_repeats(values):
    got = values(text.collapse_repeats, [
        "Passport passport PASSPORT is is here", "new passport rules new passport rules now",
        "a b a b", "ab abc ab abc x", "one two three four one two three four one two three four",
        "spam " * 5000, "Aa", "the best day the best day the best day",
    ])
    assert got == [
        "Passport is is here", "new passport rules now", "a b a b", "ab abc ab abc x",
        "one two three four one two three four", "spam", "Aa", "the best day the best day",
    ]


def test_titles(values):
    assert values(text.title_of, ["\n\n  First \r\nsecond", "one", "", None]) == ["First", "one", "", ""]


def test_sentence_helpers(values):
    assert values(text.capitalize, ["éa b", "", "x"]) == ["Éa b", "", "X"]
    assert values(text.end_sentence, ["a", "a!", "a…", ""]) == ["a.", "a!", "a…", ""]
    assert values(text.word_count, ["a  b c", "", None]) == [3, 0, 0]


def test_limit_words(values):
    limit = lambda n: lambda c: text.limit_words(c, n)
    assert values(limit(3), ["a b c", "one two three four"]) == ["a b c", "one two three."]
    # the clause ends past the middle, so the cut goes there
    assert values(limit(6), ["alpha beta gamma delta, epsilon zeta eta"]) == ["alpha beta gamma delta."]
    assert values(limit(6), ["alpha, beta gamma delta epsilon zeta eta"]) == ["alpha, beta gamma delta epsilon zeta."]
    # trailing function word and punctuation go
    assert values(limit(4), ["we went home because it rained"]) == ["we went home."]
    assert values(limit(3), ["go there https://a.b/c now"]) == ["go there."]


def test_quality_ratios(values):
    assert values(quality.repeated_char_ratio, ["aaaab", "aaab", "", "😀😀😀😀😀"]) == [0.8, 0, 0, 0]
    assert values(quality.repeated_char_ratio, ["a" * 200_000]) == [1.0]
    assert values(quality.symbol_ratio, ["a!", "!!!!", "", "😀a"]) == [0.5, 1.0, 0.0, 2 / 3]
    words = ["spam spam spam egg", "spam spam spam", "one two three four", "the the the the"]
    assert values(quality.repeated_word_ratio, words) == [0.75, 0, 0, 0]


def test_repeated_words_have_ascii_ends(values):
    got = values(lambda c: F.array_join(quality.meaningful_words(c), ","), ["café élan наука abc"])
    assert got == ["caf,lan,abc"]


def test_quality_verdict(spark):
    cases = [
        ("hello", False, 2, "too_short"),
        ("aaaa bbbbb cccc dddddd", True, 4, "repeated_characters"),
        ("!!! ??? *** ((( ))) ---", True, 4, "high_symbol_ratio"),
        ("spam spam spam spam eggs today", True, 4, "repeated_words"),
        ("a perfectly normal sentence about travel", False, 0, ""),
        ("aaaa!!!!", True, 10, "too_short,repeated_characters"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    rows = quality.text_quality(df, "t").orderBy("i").collect()
    got = [(r.is_gibberish, r.quality_score, ",".join(r.quality_reasons)) for r in rows]
    # the last one: short and all runs, symbols are exactly half, which does not count
    assert got[:5] == [c[1:] for c in cases[:5]]
    assert got[5] == (True, 6, "too_short,repeated_characters")


def test_dominant_script(values):
    got = values(language.dominant_script, [
        "पासपोर्ट सेवा", "привет", "приве", "abc", "привет " + "a" * 40, "#привет @привет x", None,
        "ਪਾਸਪੋਰਟ पासपोर्ट",
    ])
    # six letters are needed, and 15 % of all letters; equal counts go to the first block
    assert got[:7] == ["hin", "rus", None, None, None, "rus", None]
    assert got[7] == "hin" or got[7] == "pan"


def test_settle_latin(values):
    refine = lambda second: lambda c: language.refine_latin(c, F.lit("por"), F.lit(second))
    long = "isto é um texto em português bastante longo"
    assert values(refine("por"), [long]) == ["eng"]
    assert values(refine("spa"), [long, "curto"]) == ["spa", "eng"]
    assert values(refine("rus"), ["это русский текст и ещё немного"]) == ["por"]


def test_repeated_words_are_sorted_without_a_lambda(spark):
    from postlens.functions.quality import repeated_word_ratio

    df = spark.createDataFrame([("zulu alpha zulu beta zulu alpha alpha alpha",), ("one two",)], "t string")
    out = df.select(repeated_word_ratio(F.col("t")).alias("r"))
    assert [r.r for r in out.collect()] == [7 / 8, 0.0]
    assert "array_sort" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_runs_of_white_space_alone_are_replaced(values):
    from postlens.functions.patterns import WS, WS_RUN

    # a text without such a run is passed over: single blanks are no match
    texts = ["a b c d", " a ", "a  b", "a \tb", "a\t b", "a b", " 　 a\n\n b ﻿"]
    assert values(lambda t: F.regexp_count(t, F.lit(WS_RUN)), texts) == [0, 0, 1, 1, 1, 1, 3]
    assert values(lambda t: F.regexp_replace(t, WS_RUN, " "), texts) == values(
        lambda t: F.regexp_replace(t, f"{WS}+", " "), texts
    )


def test_every_repeat_passes_the_first_scan(values):
    cases = {
        "It rained rained all day": True, "Rained rained": True, "see you see you now": True,
        "one two three ONE TWO THREE end": True, "we all go home we all go home": True,
        "this is not that is this": False, "a b c a": False, "rain rains": False, "": False,
    }
    assert values(lambda t: t.rlike(text.MAY_REPEAT), list(cases)) == list(cases.values())


def test_found_agrees_with_the_spelled_out_patterns(values):
    from postlens.functions import rules, summary
    from postlens.functions.patterns import found, java

    texts = ["my passport", "éthe deal", "xdeal", "_deal", "a deal!", "deal", "😀deal😀", "Been living in Rome for", "", None,
             "so, hello", "that is so", "it cost 5 GB", "5gbx", "new passport rules", "one", "bone one", "NO REFUND", "\ndeal\n"]
    for patterns in ([p for p, _ in summary.PROMOTION_CUES], summary.META, [summary.COMPLAINT], [summary.NUMBER_WORD], rules.ON_TOPIC):
        want = [values(lambda t: t.rlike(java(p)), texts) for p in patterns]
        assert [values(lambda t: found(t, p), texts) for p in patterns] == want
        if len({p.startswith("(?i)") for p in patterns}) == 1:
            every = [None if t is None else any(w[i] for w in want) for i, t in enumerate(texts)]
            assert values(lambda t: found(t, *patterns), texts) == every


def test_repeats_next_to_each_other_are_all_dropped(values):
    cases = {
        "the the the the end": "the end", "one two one two one two": "one two one two", "abc abc ABC def def": "abc def",
        "éa éa éab éab": "éa éa éab", "a b c d a b c d": "a b c d", "said twice said twice it it it": "said twice it it it",
    }
    got = values(text.collapse_repeats, list(cases))
    assert got[0] == "the end" and got[2] == "abc def" and got[4] == "a b c d"
    assert values(text.collapse_squeezed, list(cases)) == got


def test_white_space_of_java_is_the_same_set(values):
    from postlens.functions.patterns import JAVA_WS_CHARS, WS_CHARS

    every = [chr(c) for c in [*range(0x0, 0x3100), *range(0xFE00, 0x10000)] if not 0xD800 <= c <= 0xDFFF]
    assert values(lambda t: t.rlike(f"[{JAVA_WS_CHARS}]"), every) == values(lambda t: t.rlike(f"[{WS_CHARS}]"), every)


def test_language_ranking_against_plain_python(spark):
    import random
    from postlens.operators import language_id
    from collections import Counter

    draw, letters = random.Random(5), "abcdeéñß我们ἀ\U00010400"
    word = lambda n: "".join(draw.choice(letters) for _ in range(n))
    texts = ["", None, "a", " one  two "] + [" ".join(word(draw.randint(1, 6)) for _ in range(n)) for n in (1, 9, 700, 9000) for _ in range(5)]
    # two languages are as near as each other; one of them has no name
    table = [(t, lang, i) for lang in ("x", "y", None) for i, t in enumerate(sorted({word(3) for _ in range(300)}))]
    table += [("  a", lang, 0) for lang in ("x", None)] + [(" a ", lang, 7) for lang in ("x", None)]
    profiles = spark.createDataFrame(table, "tri string, lang string, rank int")

    def plain(text):
        counts = Counter(f" {w} "[i : i + 3] for w in (text or "").lower().split() for i in range(len(w)))
        own = sorted(counts, key=lambda t: (-counts[t], t))[:300]
        saved = Counter()
        for rank, tri in enumerate(own):
            for t, lang, at in table:
                if t == tri:
                    saved[lang] += 300 - abs(rank - at)
        return sorted(((len(own) * 300 - s, lang) for lang, s in saved.items()), key=lambda x: (x[0], x[1] is None, x[1] or ""))

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    got = {r.i: [tuple(x) for x in r.found] for r in rows.select("i", language_id._ranking(profiles)(F.col("t")).alias("found")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_trimmed_ends_and_script_by_hand(values):
    from postlens.functions.language import mostly_not_latin
    from postlens.functions.patterns import trim_ws

    texts = ["", None, " ﻿a b \n", "　 ", "a \u0085", "a \u0085\n", "\x0ba\x0c", "a​ "]
    assert values(trim_ws, texts) == ["", "", "a b", "", "a\u0085", "a \u0085", "a", "a​"]
    assert values(mostly_not_latin, ["", None, "abc", "привет", "µµa", "ªº", "ab привет", "' '", "abc д"]) == [
        True, None, False, True, True, False, True, True, False,
    ]


def test_one_pass_patterns_equal_the_steps_they_replace(spark):
    import random

    from pyspark.sql import functions as F

    from postlens.functions import labels, rules
    from postlens.functions.patterns import found, squeeze, sub
    from postlens.functions.summary import COMPLAINT, NUMBER_WORD
    from postlens.functions.text import (
        lower_squeeze, strip_language_noise, word_class_squeeze, words,
    )
    from postlens.operators.language_id import letters_only

    rnd = random.Random(11)
    bits = ["new", "delhi", "New", "us", "U.S.", "u.s.a", "paris", "Paris", "é", "ß", "İ", "Σ", "á", "हिन्दी", "₹", "²",
            " ", "﻿", "\t", "\n", " ", "  ", "_", "'", "’", "-", "😀", "9", "two", "weeks", "stuck", "so", "hi", "x",
            "the the", "big big", "Big big", "a b a b", "one two x one two", "\u0085", "`", "{", "~", "@a", "http://a.b/c"]
    rows = [("".join(rnd.choice(bits) + rnd.choice(["", " ", " "]) for _ in range(rnd.randint(0, 14))),) for _ in range(1500)]
    df = spark.createDataFrame([*rows, (None,)], "t string")
    t, low = F.col("t"), F.lower(F.coalesce(F.col("t"), F.lit("")))
    sq = squeeze(t)
    keywords = sorted((k for ks in rules.REGION_KEYWORDS.values() for k in ks), key=len, reverse=True)
    body = "|".join(k.replace(".", r"\.") for k in keywords)
    places = F.array_distinct(F.regexp_extract_all(
        lower_squeeze(t), F.lit(rf"(?:^|[^\p{{L}}\p{{N}}])({body})(?![\p{{L}}\p{{N}}])"), F.lit(1)))
    first_place = F.coalesce(*[
        F.when(F.arrays_overlap(places, F.array(*[F.lit(k) for k in ks])), F.lit(n)) for n, ks in rules.REGION_KEYWORDS.items()])
    plain = sub(sub(t, (r"https?://\S+", " ")), (r"[#@][\p{L}\p{N}_-]+", " "))
    before = lambda p: sq.rlike("(?i)(?:^|\\W)(?:" + p.removeprefix(r"(?i)\b").replace(r"\b", r"(?!\w)") + ")")
    pairs = {
        "word class": (word_class_squeeze(t), squeeze(sub(low, (r"[^\p{L}\p{N}\s]", " ")))),
        "noise": (strip_language_noise(t), squeeze(sub(plain, (r"[^\p{L}\p{M}\s'’]", " ")))),
        "letters": (letters_only(t), F.regexp_replace(low, r"[^\p{L}\p{M}]+", " ")),
        "region": (labels.region(t), F.when(F.size(places) > 0, first_place)),
        "sentiment tokens": (labels.sentiment_tokens(t), words(squeeze(F.regexp_replace(
            low, r"""[\n.,/#!?$%^&*;:{}=_`"~()]""", " ")))),
        "number": (found(sq, NUMBER_WORD), before(NUMBER_WORD)), "complaint": (found(sq, COMPLAINT), before(COMPLAINT)),
    }
    wrong = df.select("t", *[F.struct(a.alias("new"), b.alias("old")).alias(n) for n, (a, b) in pairs.items()])
    for name in pairs:
        bad = wrong.filter(~F.col(f"`{name}`.new").eqNullSafe(F.col(f"`{name}`.old"))).select("t", f"`{name}`").limit(3).collect()
        assert not bad, (name, bad)
