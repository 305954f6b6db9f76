"""Column expressions of the extractive summary: tokens, post types, rewriting, guards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlens.functions.patterns import WORD_START, blank_before, found, java, let, squeeze, sub
from postlens.functions.rules import SUMMARY_STOP_WORDS
from postlens.functions.text import (
    MAX_SUMMARY_WORDS, URL, capitalize, clean_platform_noise, collapse_repeats, end_sentence,
    limit_words, sub_where, word_count, words, words_only,
)

# --- fixed values: limits -----------------------------------------------------------------
MIN_SUMMARY_WORDS = 7
TARGET_WORDS = 30
TINY_POST_WORDS = 8
SHORT_POST_WORDS = 45
MODEL_INPUT_CHARS = 4200
MAX_UNSUPPORTED = 0.34
MAX_SENTENCE_OVERLAP = 0.55
QUESTION_BOOST, COMPLAINT_BOOST = 2.5, 1.8

# --- fixed values: patterns ---------------------------------------------------------------
TLDR = r"(?i)\b(?:tl\s*;?\s*dr|tldr)\b\s*[:\-–—]?\s*(.+)$"
SENTENCE_END = r'(?<=[.!?])\s+(?=[A-ZÀ-ÖØ-Þ0-9"“‘])'
QUESTION_START = (
    r"(?i)^(does|do|is|are|can|should|would|could|has|have|why|how|what|when|where|which|who|"
    r"any(one|body)|has anyone)\b"
)
PROMOTION_CUES = [
    (r"[€$£¥]\s?\d", 1),
    (r"(?i)\d+\s?(%|percent)\s+off\b", 2),
    (r"(?i)\b(deal|discount|sale|coupon|promo|now only|buy now|shop now|order now|free shipping|"
     r"limited time|in stock)\b", 2),
    (r"(?i)\binstead of\s*[€$£¥]?\s?\d", 2),
    (r"(?i)\b(mb/s|gb/s|\d+\s?(tb|gb|mb)\b)", 1),
]
PROMOTIONAL_FROM = 3
COMPLAINT = (
    r"(?i)\b(problem|issue|complain(t|ing)?|denied|rejected|declined|refused|refuse(d)? to|"
    r"delay(ed)?|stuck|scam|unacceptable|not working|broken|frustrat\w*|annoy\w*|worst|terrible|"
    r"awful|ridiculous|wrong|error|mistake|failed|failure|no refund|no response|still no|"
    r"never (received|got|heard)|unresponsive|ignored|waste of)\b"
)
FIRST_PERSON = r"(?i)\b(i|i'm|i've|i'd|i'll|my|mine|me|myself|we|our|us)\b"
EMOTIONAL = (
    r"(?i)\b(hate|love|angry|frustrat|annoy|embarrass|humiliat|disappoint|worst|amazing|terrible|"
    r"awful|ridiculous)\b"
)
NUMBER_WORD = (
    r"(?i)\b(one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|twenty|thirty|fifty|"
    r"hundred|weeks?|days?|months?|years?|hours?)\b"
)
PROPER_NOUN = r"\b[A-Z][a-z]{2,}"
META = [
    r"(?i)^(so|ok|okay|hi|hey|hello)\b",
    r"(?i)\b(i (just )?want(ed)? to (share|say|ask|tell)|thanks in advance|any advice|"
    r"sorry for the long post|first post here)\b",
    r"(?i)\b(a little about me|(just|quick) (some )?(context|background)|for (some )?(context|background)|"
    r"about myself|i'?m an?\s+\d+[\s-]?year[\s-]?old|been (living|working|based) (in|at)\b.*\bfor\b)\b",
]
FILLERS = (
    r"(?i)\b(lowkey|highkey|ngl|tbh|imo|imho|fr fr|fr|literally|honestly|basically|actually|seriously|"
    r"like i said|i mean|you know|kinda|sorta|pretty much|at the end of the day|to be fair|"
    r"long story short|anyway|anyways|so yeah|edit|update|tldr|tl;dr)\b"
)
FILLER_REPAIRS = [
    (r"\s*[,;]\s*(?=[,;])", " "), (r"^\s*[,;:\-–—]+\s*", ""), (r"\s+([,.;!?])", "$1"),
]
PADDING = [
    (r"(?i)\b(announced|said|stated|confirmed|reported)\s+(today|yesterday|this week|on \w+day)\s+that\b",
     "$1 that"),
    (r"(?i)\b(it (is|was) (reported|announced|said) that|according to reports|sources say)\b", " "),
    (r"(?i)\b(really|quite|rather|absolutely|completely|totally|simply|truly)\s+", " "),
    (r"(?i)\b(in order to)\b", "to"),
    (r"(?i)\b(at this (point in )?time|at the moment|as of right now)\b", "now"),
    (r"(?i)\b(a total of|a number of|the fact that)\b", " "),
    (r"\s+([,.;!?])", "$1"),
]
THIRD_PERSON = [
    (r"(?i)\bI\s+am\b", "they are"), (r"(?i)\bI'm\b", "they are"),
    (r"(?i)\bI\s+have\b", "they have"), (r"(?i)\bI've\b", "they have"),
    (r"(?i)\bI'd\b", "they would"), (r"(?i)\bI'll\b", "they will"), (r"\bI\b", "they"),
    (r"(?i)\bmyself\b", "themselves"), (r"(?i)\bmine\b", "theirs"), (r"(?i)\bmy\b", "their"),
    (r"(?i)\bme\b", "them"), (r"(?i)\bourselves\b", "themselves"), (r"(?i)\bours\b", "theirs"),
    (r"(?i)\bour\b", "their"), (r"(?i)\bwe\s+are\b", "they are"), (r"(?i)\bwe're\b", "they are"),
    (r"(?i)\bwe\b", "they"), (r"(?i)\bus\b", "them"),
]
LEAD_IN = r"(?i)^(summary|in summary|the article|the post|this post|this video|the video)\s*[:,-]?\s*"
NUMBER = r"[0-9]+(?:[.,][0-9]+)?"
# ---------------------------------------------------------------------------------------


def content_tokens(text: Column) -> Column:
    """Lower-cased words of more than two characters, links and stop words left out."""
    return squeezed_tokens(squeeze(text))


def squeezed_tokens(text: Column) -> Column:
    """``content_tokens`` of a text that is squeezed already."""
    plain = words_only(sub_where(F.lower(text), ["://"], (f"(?i){URL}", " ")))
    return F.filter(
        F.split(plain, " "), lambda w: (F.length(w) > 2) & ~w.isin(SUMMARY_STOP_WORDS)
    )


def comparison_tokens(text: Column) -> Column:
    """Lower-cased words of more than two characters, stop words kept."""
    plain = words_only(F.lower(squeeze(text)))
    return F.filter(F.split(plain, " "), lambda w: F.length(w) > 2)


def author_tldr(text: Column) -> Column:
    """The author's own short version when it has 7 to 50 words, else null."""
    return let(
        clean_platform_noise(F.regexp_extract(squeeze(text), java(TLDR), 1)),
        lambda c: F.when(
            F.size(words(c)).between(MIN_SUMMARY_WORDS, MAX_SUMMARY_WORDS + 15), c
        ),
    )


def split_sentences(text: Column) -> Column:
    """Sentences of a squeezed text; empty array for an empty text."""
    parts = F.transform(F.split(text, java(SENTENCE_END)), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def is_question(text: Column) -> Column:
    return let(squeeze(text), squeezed_question)


def squeezed_question(text: Column) -> Column:
    """``is_question`` of a text that is squeezed already."""
    return F.contains(text, F.lit("?")) | text.rlike(java(QUESTION_START))


def is_promotional(text: Column) -> Column:
    return let(squeeze(text), squeezed_promotional)


def squeezed_promotional(text: Column) -> Column:
    """``is_promotional`` of a text that is squeezed already."""
    hits = [F.when(found(text, p), points).otherwise(0) for p, points in PROMOTION_CUES]
    return reduce(lambda a, b: a + b, hits) >= PROMOTIONAL_FROM


def is_complaint(text: Column) -> Column:
    return found(text, COMPLAINT)


def is_first_person(text: Column) -> Column:
    return found(text, FIRST_PERSON)


def third_person(text: Column) -> Column:
    """First person to third; a capitalised "My" or "Our" before a capital is a name."""
    guard = [(r"\bMy (?=[A-Z])", "M\u0001y "), (r"\bOur (?=[A-Z])", "O\u0001ur ")]
    return squeeze(sub(squeeze(text), *guard, *THIRD_PERSON, ("\u0001", "")))


def strip_fillers(text: Column) -> Column:
    return squeeze(sub(squeeze(text), (FILLERS, " "), *FILLER_REPAIRS))


def drop_padding(sentence: Column) -> Column:
    return squeeze(sub(squeeze(sentence), *PADDING))


def frame(raw: Column) -> Column:
    return (
        F.when(is_question(raw), "The author asks ")
        .when(raw.rlike(java(EMOTIONAL)), "The author describes how ")
        .otherwise("The author says ")
    )


def lower_first(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), text.substr(F.lit(2), F.length(text)))


def sentence_weight(
    sentence: Column, index: Column, repeated: Column, tokens: Column, different: Column | None = None
) -> Column:
    """Score of a sentence: shared vocabulary and facts, weighted by place, kind and length.

    ``repeated`` is the sum over its tokens of their count in the post, each at most three;
    ``different`` its distinct tokens, where they are known.
    """
    n_different = F.size(F.array_distinct(tokens)) if different is None else F.size(different)
    centrality = repeated / F.greatest(n_different, F.lit(1))
    informative = (
        F.when(sentence.rlike("[0-9]"), 1.2).otherwise(0.0)
        + F.when(found(sentence, NUMBER_WORD), 0.7).otherwise(0.0)
        + F.when(sentence.rlike("[€$£¥]"), 0.8).otherwise(0.0)
        + F.regexp_count(blank_before(sentence), F.lit(java(PROPER_NOUN).replace(WORD_START, r"\W"))) * F.lit(0.18)
    )
    place = F.when(index == 0, 1.1).otherwise(F.lit(1.0) / (F.lit(1.0) + index * F.lit(0.05)))
    meta = F.when(found(sentence, *META), 0.45).otherwise(1.0)
    length = F.least(F.size(tokens), F.lit(24)) / F.lit(24.0)
    return (centrality * 1.5 + informative * 0.6) * place * meta * (F.lit(0.75) + length)


PICKED = "array<struct<idx:int,sentence:string,tokens:array<string>>>"


def pick_sentences(scored: Column, budget: int, at_most: int) -> Column:
    """Greedy choice from ``array<struct<idx, sentence, tokens, words, score>>``.

    The first question, else the first complaint, is boosted (its best-scored copy, when the
    same sentence occurs again). By falling score a sentence is taken unless it repeats a
    chosen one or breaks the word budget; the chosen ones return in their own order. The
    state of the fold never holds more than ``at_most`` sentences.
    """

    def boosted(items: Column) -> Column:
        by_base = F.array_sort(
            F.transform(items, lambda s: F.struct((-s["score"]).alias("k"), s["idx"].alias("i"), s.alias("s")))
        )
        anchor = let(
            F.get(F.filter(items, lambda s: F.contains(s["sentence"], F.lit("?"))), F.lit(0)),
            lambda asked: F.when(
                asked.isNotNull(),
                F.struct(asked["sentence"].alias("text"), F.lit(QUESTION_BOOST).alias("by")),
            ).otherwise(
                let(
                    F.get(F.filter(items, lambda s: is_complaint(s["sentence"])), F.lit(0)),
                    lambda told: F.struct(told["sentence"].alias("text"), F.lit(COMPLAINT_BOOST).alias("by")),
                )
            ),
        )

        def raise_anchor(order: Column) -> Column:
            return let(
                anchor,
                lambda a: let(
                    F.get(F.filter(order, lambda o: o["s"]["sentence"] == a["text"]), F.lit(0)),
                    lambda hit: F.array_sort(
                        F.transform(
                            order,
                            lambda o: F.struct(
                                F.when(o["i"] == hit["i"], o["k"] - a["by"]).otherwise(o["k"]).alias("b"),
                                o["k"].alias("k"), o["i"].alias("i"), o["s"].alias("s"),
                            ),
                        )
                    ),
                ),
            )

        return F.transform(let(by_base, raise_anchor), lambda o: o["s"])

    empty = F.struct(
        F.array().cast(PICKED).alias("picked"), F.lit(0).alias("total"), F.lit(False).alias("done")
    )

    def step(acc: Column, s: Column) -> Column:
        def redundant(p: Column) -> Column:
            union = F.size(F.array_union(s["tokens"], p["tokens"]))
            shared = F.size(F.array_intersect(s["tokens"], p["tokens"]))
            return (union > 0) & (shared / F.greatest(union, F.lit(1)) > MAX_SENTENCE_OVERLAP)

        total = acc["total"] + s["words"]
        refused = (
            acc["done"] | (s["words"] == 0) | F.exists(acc["picked"], redundant)
            | ((F.size(acc["picked"]) > 0) & (total > budget))
        )
        new = F.struct(s["idx"].alias("idx"), s["sentence"].alias("sentence"), s["tokens"].alias("tokens"))
        full = (F.size(acc["picked"]) + 1 >= at_most) | (total >= budget - 6)
        return F.struct(
            F.when(refused, acc["picked"]).otherwise(F.concat(acc["picked"], F.array(new))).cast(PICKED).alias("picked"),
            F.when(refused, acc["total"]).otherwise(total).alias("total"),
            F.when(refused, acc["done"]).otherwise(full).alias("done"),
        )

    chosen = F.aggregate(let(scored, boosted), empty, step, lambda acc: F.array_sort(acc["picked"]))
    return F.transform(chosen, lambda p: p["sentence"])


def compress(cleaned: Column, core: Column, promotional: Column, budget: int = TARGET_WORDS) -> Column:
    """Rewrite the chosen sentences; null for an empty text."""
    joined = F.when(F.size(core) > 0, F.array_join(core, " ")).otherwise(cleaned)
    facts = end_sentence(capitalize(limit_words(strip_fillers(joined), MAX_SUMMARY_WORDS)))

    def rewrite(raw: Column) -> Column:
        return let(
            strip_fillers(drop_padding(raw)),
            lambda s: F.struct(
                raw.alias("raw"), s.alias("text"),
                (~F.contains(s, F.lit("?")) & is_first_person(s)).alias("own"),
            ),
        )

    def told(parts: Column) -> Column:
        # the frame is put once, on the first sentence told in the first person
        framed = F.array_position(F.transform(parts, lambda p: p["own"]), F.lit(True))

        def tell(p: Column, i: Column) -> Column:
            return let(
                third_person(p["text"]),
                lambda t: F.when(~p["own"], p["text"])
                .when(framed == i + 1, F.concat(frame(p["raw"]), lower_first(t)))
                .otherwise(t),
            )

        return F.array_join(F.transform(parts, lambda p, i: capitalize(tell(p, i))), " ")

    sentences = F.when(F.size(core) > 0, core).otherwise(F.array(cleaned))
    body = collapse_repeats(let(F.transform(sentences, rewrite), told))
    short = limit_words(body, min(budget + 5, MAX_SUMMARY_WORDS))
    retold = F.regexp_replace(end_sentence(capitalize(short)), r"\.{2,}", ".")
    return F.when(cleaned != "", F.when(promotional, facts).otherwise(retold))


def tiny_label(full: Column, cleaned: Column) -> Column:
    """Label of a post of at most eight words; null when cleaning leaves nothing."""
    complete = end_sentence(capitalize(cleaned))

    def label(subject: Column) -> Column:
        kind = F.when(is_question(cleaned), "Short post asking about ").otherwise("Short post about ")
        return F.when(~subject.rlike(r"[\p{L}\p{N}]"), complete).otherwise(
            F.concat(kind, lower_first(subject), F.lit("."))
        )

    sentence = full.rlike("[.!?]$") & (F.size(words(cleaned)) >= 4)
    return (
        F.when(cleaned == "", F.lit(None).cast("string"))
        .when(sentence, complete)
        .otherwise(let(F.trim(F.regexp_replace(cleaned, "[.!?]+$", "")), label))
    )


def tidy_candidate(candidate: Column) -> Column:
    """A model's text without markdown marks and lead-in, held to the word limit."""
    plain = sub(squeeze(candidate), (r"[#*_`]+", " "), (r"\s+", " "))
    return limit_words(squeeze(sub(squeeze(plain), (LEAD_IN, ""))), MAX_SUMMARY_WORDS)


# --- guards over (source, summary) --------------------------------------------------------
def degenerate(summary: Column) -> Column:
    """A word or a phrase of two to four words said twice in a row."""

    def repeats(w: Column) -> Column:
        def said_twice(size: int) -> Column:
            starts = F.when(
                F.size(w) >= 2 * size, F.sequence(F.lit(1), F.size(w) - 2 * size + 1)
            ).otherwise(F.array().cast("array<int>"))
            limit = 2 if size == 1 else 8
            return F.exists(
                starts,
                lambda i: (F.slice(w, i, F.lit(size)) == F.slice(w, i + size, F.lit(size)))
                & (F.length(F.array_join(F.slice(w, i, F.lit(size)), " ")) > limit),
            )

        return reduce(lambda a, b: a | b, [said_twice(n) for n in (1, 2, 3, 4)])

    return let(words(squeeze(F.regexp_replace(F.lower(squeeze(summary)), "[-–—]", " "))), repeats)


def copied_phrase(source: Column, summary: Column) -> Column:
    """At least 55 % of the summary's six-word runs occur in the source.

    A run occurs when its words, blank-separated, are found in the source's words.
    """
    n = 6

    def share(s: Column) -> Column:
        shingles = F.transform(
            F.sequence(F.lit(1), F.size(s) - n + 1),
            lambda i: F.concat(F.lit(" "), F.array_join(F.slice(s, i, F.lit(n)), " "), F.lit(" ")),
        )
        return let(
            comparison_tokens(source),
            lambda src: let(
                F.concat(F.lit(" "), F.array_join(src, " "), F.lit(" ")),
                lambda line: F.when((F.size(s) < 8) | (F.size(src) < 12), F.lit(False)).otherwise(
                    F.size(F.filter(shingles, lambda x: F.contains(line, x))) / F.size(shingles) >= 0.55
                ),
            ),
        )

    return let(comparison_tokens(summary), share)


def verbatim_prefix(source: Column, summary: Column) -> Column:
    """A summary of at least eight words that starts the source word by word."""
    return let(
        comparison_tokens(summary),
        lambda s: (F.size(s) >= 8)
        & (F.slice(comparison_tokens(source), F.lit(1), F.greatest(F.size(s), F.lit(1))) == s),
    )


def unfaithful(source: Column, summary: Column) -> Column:
    """A number the source lacks, or too many content words without a counterpart in it.

    Two words correspond when the shorter of their five-letter beginnings starts the other.
    """
    numbers = lambda t: F.transform(
        F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("."))
    )
    begin = lambda w: F.substring(w, 1, 5)

    def unsupported(beginnings: Column) -> Column:
        def alone(t: Column) -> Column:
            return ~F.exists(
                beginnings, lambda b: F.startswith(b, begin(t)) | F.startswith(t, b)
            )

        return let(
            content_tokens(summary),
            lambda ts: (F.size(ts) > 0)
            & (F.size(F.filter(ts, alone)) / F.greatest(F.size(ts), F.lit(1)) > MAX_UNSUPPORTED),
        )

    beginnings = F.array_distinct(F.transform(content_tokens(source), begin))
    invented = F.size(F.array_except(numbers(summary), numbers(source))) > 0
    return invented | let(beginnings, unsupported)


def lost_words(source: Column, summary: Column) -> Column:
    """A summary of fewer than seven words for a source of more than eighteen."""
    return (word_count(summary) < MIN_SUMMARY_WORDS) & (word_count(source) > 18)


def lost_question(source: Column, summary: Column) -> Column:
    return is_question(source) & ~F.contains(summary, F.lit("?"))
