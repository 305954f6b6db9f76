from pyspark.sql import functions as F

from postlens.functions import labels
from postlens.functions.posts import category_name, profile_url


def relevance(values, texts):
    return [(r.is_relevant, r.reason, r.matched) for r in values(labels.relevance, texts)]


def test_relevance_branches(values):
    got = relevance(values, [
        None, "  ", "My passport holder is new", "My   PASSPORT renewal", "passport", "A visa question",
        "nothing here", "new passport for the Honda Passport",
    ])
    assert got == [
        (False, "empty_text", None), (False, "empty_text", None),
        (False, "irrelevant_passport_usage", "passport holder"),
        (True, "passport_context_detected", None),
        (False, "passport_without_meaningful_context", None),
        (False, "related_topic_without_passport_context", "visa"),
        (False, "no_passport_topic_term", None),
        (False, "irrelevant_passport_usage", "honda passport"),
    ]


def test_category_groups(values):
    cases = {
        "passport appointment and renewal": "Appointments",
        "passport renewal by tatkal": "Renewal",
        "tatkal passport scam": "Tatkal",
        "a fake agent and a visa": "Scams/Fraud",
        "the passport index": "Visa",
        "how to apply for a passport": "Application",
        "पासपोर्ट फोटो": "Application",
        "passport stopped at the border": "Travel Issues",
        "the ministry and the passport": "Government Announcements",
        "passport scandal": "News",
        "my passport": "Personal Experiences",
        "hello": None,
    }
    got = [r.category for r in values(labels.rule_category, list(cases))]
    assert got == list(cases.values())


def test_category_reads_whole_texts(values):
    got = values(labels.rule_category, ["x" * 506 + " tatkal", "x " * 400 + "tatkal", ""])
    assert [r.category for r in got] == ["Tatkal", "Tatkal", None]
    assert [r.method for r in got] == ["domain_rule", "domain_rule", "none"]


def test_category_reads_up_to_a_given_length(values):
    got = values(lambda t: labels.rule_category(t, 512), ["x" * 505 + " tatkal", "x" * 506 + " tatkal"])
    assert [r.category for r in got] == ["Tatkal", None]


def test_regions(values):
    got = values(labels.region, [
        "tell us more", "from India to the US", "the U.S.A today", "Indiana", "u.a.e", "éus", "(London)",
        "New   Zealand", None, "nothing", "São Paulo, rome",
    ])
    assert got == [
        "UnitedStates", "India", "UnitedStates", None, "UnitedArabEmirates", None, "UnitedKingdom",
        "NewZealand", None, None, "Italy",
    ]


def test_sentiment(values):
    got = values(labels.sentiment_score, ["good", "fast", "not good", "awful, bad!", "good bad", "", None])
    assert got == [2, 1, -2, -6, -1, 0, 0]
    assert values(labels.sentiment, ["good", "fast", "not good", "slow"]) == [
        "Positive", "Neutral", "Negative", "Neutral",
    ]


def test_category_names(values):
    got = values(category_name, [
        None, "", "Visa", '{"category":"A","name":"B"}', '{"category":"","name":"B"}', '{"category":0,"label":"C"}',
        '{"x":1}', '"Quoted"', "null", "12", "true", "[1]", "{broken", '{"category":false,"primary":"P"}',
    ])
    assert got == ["", "", "Visa", "A", "B", "C", "", "Quoted", "null", "12", "true", "", "{broken", "P"]


def test_profile_url(values):
    url = lambda h: lambda c: profile_url(F.lit(h), c)
    assert values(url("a.b"), ["at://x/y/rk1", "", None]) == ["https://bsky.app/profile/a.b/post/rk1", None, None]
    assert values(url(""), ["at://x/y/rk1"]) == [None]


def test_literals_of_patterns():
    from postlens.functions.patterns import literals

    assert literals(r"\bpassport.*appointment\b") == ["passport", "appointment"]
    assert literals(r"\bpassport documents?\b") == ["passport document"]
    assert literals(r"\bvisa[- ]free\b") == ["visa", "free"]
    assert literals(r"u\.s\.a\s+x+y*z{2}") == ["u.s.a", "x"]
    assert literals("(a|b)c") == literals("a|b") == []


def test_category_rules_with_gaps_equal_the_plain_patterns(spark):
    import random
    import re

    from pyspark.sql import functions as F

    from postlens.functions import rules
    from postlens.functions.labels import rule_category

    rng = random.Random(4)
    words = ["passport", "appointment", "visa", "border", "stopped", "official", "rescheduled", "passports", "my", "apply", "for",
             "new", "visa-free", "documents", "th-ai", "สอบ", "x", "doors", "trump", "renewal", "tatkal", "Passport", "é"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(1500)]

    def first(text):
        for name, patterns in rules.CATEGORY_RULES.items():
            if any(re.search(p, text.lower(), re.ASCII) for p in patterns):
                return name
        return None

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", rule_category(F.col("t"))["category"].alias("c"))
    assert [(t, c) for t, c in df.collect() if c != first(t)] == []


def test_a_row_is_labelled_once_for_the_whole_fit(spark):
    from postlens.operators import categorize as C

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        seen.add(1)
        return {"v": "Visa", "r": "Renewal"}.get(text[0])

    texts = ["visa stamp page", "renewal of it", "visa office", "renewal late", "other thing"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, original_text string")
    model = C.train_classifier(rows.withColumn("category", told("original_text")))
    assert seen.value == len(texts)
    got = C.categorize(rows, C.score_with(model)).orderBy("id").collect()
    assert model.stages[0].labels == ["Renewal", "Visa"] and len(got) == len(texts)
    assert all(abs(sum(r.all_scores.values()) - 1) < 1e-9 for r in got if r.method == "scored")


def test_ascii_is_no_part_of_the_listed_scripts():
    import re

    from postlens.functions.language import ANY_SCRIPT_BLOCK

    # a plain letter must leave the class at its first test: the range around all blocks
    first, last = re.match(r"\[(.)-(.)&&", ANY_SCRIPT_BLOCK, re.S).groups()
    assert "ɏ" < first < last


def test_signed_words_with_unlisted_ones_between(spark):
    rows = [("good", 3), ("not good", -3), ("not very good", 3), ("good not", 3), ("not, good", -3), ("", 0), (None, 0),
            ("not bad bad", -1), ("good\tgood\ngood", 9)]
    lexicon = {3: ["good"], -1: ["bad"]}
    df = spark.createDataFrame(rows, "t string, want long")
    got = [(r.t, r.got) for r in df.select("t", labels.sentiment_score(F.col("t"), lexicon).alias("got")).collect()]
    assert got == [(t, 0 if t and "bad" in t else w) for t, w in rows]  # minus one is turned and taken once


def test_sentiment_plan_asks_for_listed_words_first(spark):
    text = spark.range(1).select(labels.sentiment_score(F.lit("a")).alias("s"))._jdf.queryExecution().analyzed().toString()
    # the fold runs over the scores found, not over every word of a text
    assert "filter(transform(" in text
