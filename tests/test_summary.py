from pyspark.sql import functions as F

from postlens.functions import summary as S
from postlens.operators import language_id, summarize
from postlens.operators.enrich import enrich


def run(spark, texts, candidates=None):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, original_text string")
    given = None
    if candidates:
        given = spark.createDataFrame([(i, c) for i, c in enumerate(candidates)], "id int, candidate string")
    out = summarize.summarize(df, ["id"], candidates=given).orderBy("id").collect()
    return [(r.summary, r.method) for r in out]


def test_tldr_length(values):
    say = lambda n: "Long text. TL;DR: " + " ".join(f"w{i}" for i in range(n))
    got = values(S.author_tldr, [say(6), say(7), say(50), say(51), "no marker here"])
    assert [g is not None for g in got] == [False, True, True, False, False]


def test_sentences(values):
    got = values(S.split_sentences, ["One. Two! three? Four 5. 6 is. “Q” end", ""])
    assert got == [["One.", "Two! three?", "Four 5.", "6 is.", "“Q” end"], []]


def test_post_types(values):
    assert values(S.is_question, ["see http://a.b/?q=1", "Does it work", "anyone there", "done"]) == [True, True, True, False]
    promo = ["50% off, now only $20", "costs $20", "on sale at $20", "Instead of $30, 1 TB"]
    assert values(S.is_promotional, promo) == [True, False, True, True]


def test_third_person(values):
    got = values(S.third_person, [
        "I am late and I've lost my bag", "The WD My Passport drive is my favourite", "We're here with us", "me and mine",
    ])
    assert got == [
        "they are late and they have lost their bag", "The WD My Passport drive is their favourite",
        "they are here with them", "them and theirs",
    ]


def test_rewriting(values):
    assert values(S.strip_fillers, ["Honestly, it is basically fine , tbh"]) == ["it is fine,"]
    assert values(S.drop_padding, ["They announced today that it is really slow in order to save"]) == [
        "They announced that it is slow to save"
    ]


def test_tiny_labels(spark):
    got = run(spark, ["New Passport Rules 2026", "is this real", "It is done now.", "!!! ???", "", None])
    assert got == [
        ("Short post about new Passport Rules 2026.", "tiny_post_label"),
        ("Short post asking about is this real.", "tiny_post_label"),
        ("It is done now.", "tiny_post_label"),
        ("!!! ???", "tiny_post_label"),
        (None, "none"), (None, "none"),
    ]


def test_short_post_is_framed_once(spark):
    text = "I waited three weeks for my passport in London. My renewal was delayed again and I am stuck."
    [(summary, method)] = run(spark, [text])
    assert method == "compressor_short_post"
    assert summary == (
        "The author says they waited three weeks for their passport in London. "
        "Their renewal was delayed again and they are stuck."
    )


def test_routes_of_long_posts(spark):
    body = " ".join(f"The office number {i} opened its doors to people from town {i}." for i in range(8))
    good = "Eight office numbers opened their doors to people from towns this season."
    question = body + " When will the next one open?"
    got = run(spark, [body, question, body, body], [good, good, "Office office office", ""])
    assert [m for _, m in got] == ["model", "compressor_type_routed", "compressor_quality_guard", "compressor_model_empty"]
    assert got[0][0] == good
    assert "When will the next one open?" in got[1][0]
    [(_, cleaned)] = run(spark, ["#a #b #c #d #e #f #g #h #i"])
    assert cleaned == "cleaned_empty"


def test_sentence_scores(spark):
    df = spark.createDataFrame([(1, "Passport office closed. Passport office in Delhi opened 3 days ago.")], "id int, t string")
    [row] = summarize.score_sentences(summarize.placed(df, ["id"], "t"), ["id"]).collect()
    first, second = row.scored
    # passport and office occur twice each, closed once; one proper noun
    assert abs(first.score - ((5 / 3) * 1.5 + 0.18 * 0.6) * 1.1 * (0.75 + 3 / 24)) < 1e-9
    facts = 1.2 + 0.7 + 2 * 0.18
    assert abs(second.score - ((8 / 6) * 1.5 + facts * 0.6) * (1 / 1.05) * (0.75 + 6 / 24)) < 1e-9


def test_choice_skips_near_copies_and_keeps_order(spark):
    text = (
        "The new fee starts in March for adults. The new fee starts in March for all adults. "
        "Children pay 20 dollars. Why was nobody told?"
    )
    df = spark.createDataFrame([(1, text)], "id int, t string")
    [row] = summarize.core_sentences(df, ["id"], "t", budget=30, at_most=4).collect()
    assert "Why was nobody told?" in row.core
    assert sum("fee starts" in s for s in row.core) == 1
    assert row.core == sorted(row.core, key=text.index)


def test_guards(spark):
    source = "The passport office in Delhi closed 3 days ago because of heavy rain across the whole city area"
    rows = [
        (source, "very very slow", True, False, False, True),
        (source, "go now fast go now fast end", True, False, False, True),
        (source, source, False, True, True, False),
        (source, "the passport office closed 4 days ago", False, False, False, True),
        (source, "passports offices closing rainy city", False, False, False, False),
    ]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, source string, summary string")
    got = summarize.summary_guards(df).orderBy("i").collect()
    assert [(r.degenerate, r.copied, r.verbatim, r.unfaithful) for r in got] == [r[2:] for r in rows]


def test_repeated_weights_against_a_plain_count(spark):
    texts = [
        [["a", "b", "a"], [], ["a", "c", "a", "a"], ["b"]], [[]], [], [["x"]], [["y"] * 5, ["y"]],
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t array<array<string>>")
    got = {r["id"]: r["w"] for r in df.select("id", summarize.repeated_weights(F.col("t")).alias("w")).collect()}
    for i, lists in enumerate(texts):
        every = [w for ws in lists for w in ws]
        assert got[i] == [sum(min(3, every.count(w)) for w in ws) for ws in lists]


def test_labels_language_and_summary_place_no_text(spark):
    df = spark.createDataFrame([(1, "passport renewal took nine weeks. " * 20)], "id int, original_text string")
    profiles = language_id.train_profiles(spark.createDataFrame([("passport weeks", "eng")], "text string, lang string"))
    out = enrich(df, profiles)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    [row] = out.collect()
    assert row["language"] == "eng"


def test_summary_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame(
        [(1, None, "f", 2), (2, "", "g", 3), (3, "Short and sweet words here", "h", 4)],
        "id int, t string, full string, cleaned int",
    )
    rows = {r["id"]: r for r in summarize.with_summary(df, F.col("t")).collect()}
    assert [rows[i]["full"] for i in (1, 2, 3)] == ["f", "g", "h"]
    assert rows[1]["summary"] is None and rows[1]["method"] == "none"
    assert rows[3]["cleaned"] == 4 and rows[3]["summary"]


def test_repeated_weights_of_empty_and_null_lists(spark):
    rows = [(1, [["a", "b"], [], ["a", "a", "a"]]), (2, []), (3, None), (4, [[]]), (5, [["a"], ["b", "b"]])]
    df = spark.createDataFrame(rows, "id int, t array<array<string>>").repartition(1)
    got = {r["id"]: r["w"] for r in df.select("id", summarize.repeated_weights(F.col("t")).alias("w")).collect()}
    assert got == {1: [4, 0, 9], 2: [], 3: None, 4: [0], 5: [1, 4]}
    # a call outside the expressions of a row: batches of it are counted at once
    assert "ArrowEvalPython" in df.select(summarize.repeated_weights(F.col("t")))._jdf.queryExecution().executedPlan().toString()
