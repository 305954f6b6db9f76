from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from postlens.operators import translate as T


def test_sources(values):
    got = values(T.normalize_source, ["English", " HI ", "sco", "und", "unknown", "por", "zho", "xx1", None, "ara"])
    assert got == ["eng", "hin", "eng", None, None, None, "cmn", None, None, "arb"]
    assert values(T.raw_source, ["por", "Portuguese", "und", "pt", "EN"]) == ["por", None, None, "pt", "eng"]


def plan(spark, rows, mode):
    schema = "id int, text string, source_language string, target_language string, translations map<string,string>"
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
    many = spark.createDataFrame([("por",), ("lat",)], "code string")
    out = T.translation_plan(T.with_source(df, many), mode, T.MAX_CHARS).orderBy("id").collect()
    return [(r.method, r.error, r.truncated_at) for r in out]


def test_routes(spark):
    none, long = {}, "x" * 600
    rows = [
        ("t", "en", "Hindi", {"hindi": "saved"}), ("t", "en", "Hindi", {"hindi": "  "}), (long, "hi", "english", none),
        ("t", "hindi", "german", none), ("t", "por", "english", none), ("t", "por", "german", none),
        ("t", "por", "punjabi", none), ("t", "en", "punjabi", none), (long, "en", "english", none),
        ("t", "en", "klingon", none), ("t", "qqq", "english", none), ("", "en", "hindi", none),
        (long, "en", "hindi", {"hindi": "saved"}),
    ]
    assert plan(spark, rows, "local") == [
        ("cached", None, None), ("local_model", None, None), ("local_model", None, 512),
        ("local_model_pivot_via_english", None, None), ("local_model_fallback_multilingual", None, None),
        ("local_model_fallback_multilingual_pivot_via_english", None, None), (None, "no_route_to_punjabi", None),
        ("remote_libretranslate", None, None), ("no_translation_needed", None, None),
        (None, "unsupported_target", None), (None, "unsupported_source", None), (None, "text_required", None),
        ("cached", None, 512),
    ]
    remote = plan(spark, rows, "remote")
    assert remote[3] == ("remote_mymemory", None, None)
    assert remote[4] == (None, "remote_unsupported_source", None)
    assert remote[7] == ("remote_mymemory", None, None)


def test_chunks(values):
    cut = lambda n: lambda c: T.chunk_text(c, n)
    assert values(cut(10), ["short", "One two. Three. Four five six.", "abcdefghijklmno. Z"]) == [
        ["short"], ["One two.", "Three.", "Four five ", "six."], ["abcdefghij", "klmno. Z"],
    ]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab. é語😀?\n", min_size=0, max_size=80), min_size=1, max_size=15))
def test_chunks_lose_nothing(values, texts):
    chunked = values(lambda c: T.chunk_text(c, 16), texts)
    squeeze = lambda s: "".join(s.split())
    for text, chunks in zip(texts, chunked):
        assert squeeze("".join(chunks)) == squeeze(text)
        assert all(len(c.encode()) <= 16 for c in chunks)


def test_translator_gets_pivots_twice(spark):
    schema = "id int, text string, source_language string, target_language string, translations map<string,string>"
    rows = [(1, "a", "hi", "german", {}), (2, "b", "en", "german", {}), (3, "c", "de", "german", {}), (4, "d", "de", "x", {})]
    many = spark.createDataFrame([("por",)], "code string")
    planned = T.translation_plan(T.with_source(spark.createDataFrame(rows, schema), many))
    say = lambda texts, a, b: [f"{t}|{a}>{b}" for t in texts]
    got = {r.id: (r.translated, r.error) for r in T.translate(planned, ["id"], say).collect()}
    assert got == {1: ("a|hi>en|en>de", None), 2: ("b|en>de", None), 3: ("c", None), 4: (None, "unsupported_target")}


def test_whole_texts_are_translated(spark):
    schema = "id int, text string, source_language string, target_language string, translations map<string,string>"
    long = " ".join(f"Sentence {i} of a long text." for i in range(200)) + " The end."
    rows = [(1, long, "hi", "english", {}), (2, "x" * 1300, "hi", "english", {}), (3, "kurz", "de", "english", {})]
    many = spark.createDataFrame([("por",)], "code string")
    sourced = T.with_source(spark.createDataFrame(rows, schema), many)
    say = lambda texts, a, b: [t.upper() for t in texts]
    for mode in ("local", "remote"):
        got = {r.id: r for r in T.translate(T.translation_plan(sourced, mode), ["id"], say).collect()}
        assert got[1].translated == long.upper() and got[1].truncated_at is None
        assert got[2].translated.replace(" ", "") == "X" * 1300
        assert got[3].translated == "KURZ"
    cut = T.translate(T.translation_plan(sourced, "local", T.MAX_CHARS), ["id"], say).collect()
    assert {r.id: len(r.translated) for r in cut} == {1: 512, 2: 512, 3: 4}


def test_code_table_may_be_large(spark):
    requests = spark.createDataFrame([(1, "por"), (2, "qqq"), (3, None)], "id int, source_language string")
    many = spark.range(20_000).selectExpr("CASE WHEN id < 3 THEN 'por' WHEN id > 5 THEN 'c' || id END AS code")
    got = T.with_source(requests, many).orderBy("id").collect()
    assert [(r.source_code, r.via_many) for r in got] == [("por", True), (None, None), (None, None)]


def test_a_worker_holds_few_texts_at_once(spark, tmp_path):
    import glob

    whole = ("x" * 99 + ". ") * 3000
    rows = [(i, "local_model", whole, "en", "de") for i in range(12)]
    planned = spark.createDataFrame(rows, "id int, method string, text string, source_suffix string, target_suffix string").withColumns(
        {"error": F.lit(None).cast("string"), "truncated_at": F.lit(None).cast("int"), "cached": F.lit(None).cast("string"),
         "remote_source": F.lit(None).cast("string"), "remote_target": F.lit(None).cast("string"), "source_code": F.col("source_suffix"),
         "target_suffix": F.col("target_suffix")}
    ).repartition(1)
    folder = str(tmp_path)

    def say(texts, a, b):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
            out.write(str(sum(map(len, texts))))
        return texts

    got = {r.id: r.translated for r in T.translate(planned, ["id"], say).collect()}
    assert sorted(got) == list(range(12)) and all(t.replace(" ", "") == whole.replace(" ", "") for t in got.values())
    given = [int(open(f).read()) for f in glob.glob(f"{folder}/*")]
    assert sum(given) >= 12 * 300_000 and max(given) <= T.WORKER_BYTES


def test_phrase_table_on_odd_texts(spark):
    rows = [
        (1, " a  b c a ", "en", "de"), (2, "", "en", "de"), (3, None, "en", "de"), (4, "a b", None, "de"),
        (5, "a b", "fr", "de"), (None, "b\ta", "en", "de"), (6, "a x", "en", "de"), (6, "b", "fr", "de"), (7, "long", "en", "de"),
    ]
    df = spark.createDataFrame(rows, "id int, text string, source string, target string")
    said = [("en", "de", "a", "A"), ("en", "de", "a", "Z"), ("en", "de", "b", None), ("fr", "de", "b", "B"), (None, "de", "a", "N"), ("en", "de", "", "-")]
    phrases = spark.createDataFrame(said, "source string, target string, word string, said string")
    out = T.translate_by_table(df, phrases, ["id"])
    assert {r.id: r.translated for r in out.collect()} == {
        1: "- A b c A -", 2: "-", 4: "a b", 5: "a B", None: "b A", 6: "A B x", 7: "long",
    }
    # the words of a text are not sent one by one
    words = spark.createDataFrame([(1, "a " * 4000, "en", "de")], df.schema)
    plan = T.translate_by_table(words, phrases, ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" in plan and "posexplode" not in plan
