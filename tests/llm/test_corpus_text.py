"""Language, personal data, LM scores, chats, fingerprints and mixing."""

import hashlib
import itertools
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.llm import chat_format, lm_scoring, mixing, pii
from postlens.llm.fingerprints import fingerprints, within
from postlens.llm.language_id import drop_unidentified, predictions


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = predictions(docs).collect()
    assert len(got) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_rows(table, odd_rows):
    got = predictions(table(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert und == {1, 2, 3, 11} and all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert predictions(table([])).count() == 0
    assert {r["lang_pred"] for r in predictions(table(odd_rows, lang=None)).collect()} == {"und"}


def test_unidentified_rows_go(table, odd_rows):
    left = drop_unidentified(table(odd_rows))
    assert left.columns == table([]).columns and left.count() == len(odd_rows) - 4


def test_texts_stay_where_no_language_can_be_learnt(table, odd_rows):
    left = drop_unidentified(table(odd_rows, lang=None))
    assert left.columns == table([]).columns and left.count() == len(odd_rows) - 4
    assert drop_unidentified(table([], lang=None)).count() == 0


def test_missing_languages_are_predicted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang is not null")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    hidden = docs.withColumn("lang", F.when(F.col("doc_id") % 5 != 0, F.col("lang")))
    left = drop_unidentified(hidden)
    assert left.schema["lang"].dataType == docs.schema["lang"].dataType
    got = {r["doc_id"]: r["lang"] for r in left.select("doc_id", "lang").collect()}
    assert all(got[i] == lang[i] for i in got if i % 5)
    filled = [i for i in got if i % 5 == 0]
    assert len(filled) > 100 and sum(got[i] == lang[i] for i in filled) / len(filled) > 0.97


def base_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_plain_personal_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pii.personal_data(docs).collect():
        want = base_spans(texts[r["doc_id"]])
        named = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(named.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in want) for k in pii.KINDS]
        assert set(named.split(",")) - {""} <= set(r["spans"].split(","))


def test_plain_spans_of_random_texts():
    import random

    rng = random.Random(3)
    parts = ["a", "b.c", "@", ".", "-", "+", "1", "23", "255", "256", " ", "(", ")", "4539 1488 0343 6467", "x@y.z", "٣", "\n"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert pii.plain_spans(text) == base_spans(text), text


@pytest.mark.parametrize("text, kind, span", [
    ("mail john.doe at example dot com now", "email", "john.doe at example dot com"),
    ("j [at] ex.org", "email", "j [at] ex.org"),
    ("j[dot]doe[at]ex[dot]com", "email", "j[dot]doe[at]ex[dot]com"),
    ("to jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("ip １９２.１６８.0.1 here", "ip", "１９２.１６８.0.1"),
    ("ip 10 dot 0 dot 0 dot 1", "ip", "10 dot 0 dot 0 dot 1"),
    ("card four five three nine 1488 0343 6467 x", "card", "four five three nine 1488 0343 6467"),
    ("call plus four nine one seven six five five five one two three", "phone", "plus four nine one seven six five five five one two three"),
    ("😀 j (at) ex (dot) org", "email", "j (at) ex (dot) org"),
])
def test_disguises_map_back(text, kind, span):
    plain, spans = pii.find(text)
    assert plain == [] and [(k, text[a:b]) for k, a, b in spans] == [(kind, span)]


@pytest.mark.parametrize("span", [
    "192dot168dot0dot1", "192 dot168 dot0 dot1", "192DOT 168Punkt 0punto1", "192[.]168[.]0[.]1",
    "192 (.) 168 (.) 0 (.) 1", "192[dot]168[.]0.1", "1{.}1<.>1[.]1",
])
def test_disguised_dots_of_addresses(span):
    plain, spans = pii.find(f"ip {span} here")
    assert plain == [] and [(k, f"ip {span} here"[a:b]) for k, a, b in spans] == [("ip", span)]


def test_bracketed_dots_of_names():
    text = "to jo[.]doe@ex[.]com now"
    assert [(k, text[a:b]) for k, a, b in pii.find(text)[1]] == [("email", "jo[.]doe@ex[.]com")]


@pytest.mark.parametrize("text", ["look at the dot com", "Look at example.com", "at one two three", "the plus point is", "a point 3"])
def test_plain_prose_is_left(text):
    assert pii.find(text) == ([], [])


def test_masking_and_odd_rows(table, odd_rows):
    text = "a x@y.zz and +49 176 555 12345."
    assert pii.mask(text, pii.find(text)[1]) == "a <email> and <phone>."
    got = pii.personal_data(table(odd_rows)).collect()
    assert len(got) == len(odd_rows) and all(r["spans"] == "" for r in got if r["doc_id"] in (1, 2, 3))
    assert pii.personal_data(table([])).count() == 0


def test_lm_gradient_and_scores(table, docs, odd_rows):
    rng = np.random.default_rng(0)
    context, target = rng.integers(0, lm_scoring.CLASSES, (40, 4)), rng.integers(0, lm_scoring.CLASSES, 40)
    weights = lm_scoring.initial()
    before = -lm_scoring.log_probability(lm_scoring.parts(weights), context, target).mean()
    w = lm_scoring.parts(weights)
    g2 = {k: np.full(s, 1e-6, np.float32) for k, s in lm_scoring.SHAPES.items()}
    for _ in range(50):
        lm_scoring.train_batch(w, g2, context, target)
    assert -lm_scoring.log_probability(w, context, target).mean() < before - 1
    model = lm_scoring.fit(docs)
    got = {r["doc_id"]: r for r in lm_scoring.pseudo_likelihood(docs, model).collect()}
    raw = {r["doc_id"]: r for r in lm_scoring.pseudo_likelihood(docs, (model[0], lm_scoring.initial())).collect()}
    assert sum(r["sum_log_probability"] for r in got.values()) > sum(r["sum_log_probability"] for r in raw.values())
    odd = lm_scoring.pseudo_likelihood(table(odd_rows)).collect()
    assert len(odd) == len(odd_rows)
    assert all(r["n_words"] == 0 and r["sum_log_probability"] == 0 and r["mean_log_probability"] is None for r in odd if r["doc_id"] in (1, 2, 3))
    assert lm_scoring.pseudo_likelihood(table([])).count() == 0


def test_lm_score_is_the_sum_of_conditionals(docs):
    import pyarrow as pa

    vocabulary, weights = lm_scoring.fit(docs)
    text = "the cat and the dog of it"
    n, total = lm_scoring.score_texts(pa.array([text, "x", text]), vocabulary, weights)
    names = lm_scoring.names_of(lm_scoring.Words(pa.array([text]), lower=True))
    classes = [0, 0, *vocabulary.classes[names], 0, 0]
    w, want = lm_scoring.parts(weights), 0.0
    for i in range(2, len(classes) - 2):
        x = np.concatenate([w["embed"][classes[i + d]] for d in (-2, -1, 1, 2)])
        z = np.tanh(x @ w["inner"] + w["inner0"]) @ w["outer"] + w["outer0"]
        want += z[classes[i]] - np.log(np.exp(z).sum()) + vocabulary.share[names[i - 2]]
    assert n.tolist() == [7, 1, 7] and total[0] == pytest.approx(want, rel=1e-4) and total[2] == pytest.approx(total[0])


def test_lm_tells_all_words_apart(table):
    """Of very many words some agree in the leading bits of their hash."""
    import pyarrow as pa

    fillers = [f"f{i}" for i in range(200)]
    seldom = "common"
    hashes = lm_scoring.Words(pa.array([f"{seldom} " + " ".join(f"u{i}" for i in range(1 << 20))])).hash >> np.uint64(46)
    twin = f"u{int(np.flatnonzero(hashes[1:] == hashes[0])[0])}"
    rows = [(i, " ".join([w] * 30 + [seldom])) for i, w in enumerate(fillers)]
    # Frequent words take all classes of their own; the seldom one and its twin share theirs.
    rows += [(1000 + i, " ".join([f"f{i}"] * 400)) for i in range(lm_scoring.FREQUENT)]
    vocabulary, weights = lm_scoring.fit(table(rows))
    names = lm_scoring.names_of(lm_scoring.Words(pa.array([f"{seldom} {twin} f199"])))
    assert len(set(names.tolist())) == 3
    share = vocabulary.share[names]
    assert share[0] > share[1] + 4  # met 200 times, never met
    got = lm_scoring.pseudo_likelihood(table([(1, seldom), (2, twin), (3, f"f0 {twin} f199"), (None, None)]), (vocabulary, weights)).collect()
    got = {r["doc_id"]: r["sum_log_probability"] for r in got}
    n, want = lm_scoring.score_texts(pa.array([seldom, twin, f"f0 {twin} f199", ""]), vocabulary, weights)
    assert [got[1], got[2], got[3], got[None]] == pytest.approx(want.tolist()) and n.tolist() == [1, 1, 3, 0]


def test_lm_trains_on_every_word(spark, table):
    """Also on the words of a short text, in whichever order the texts come."""
    import pyarrow as pa
    from dataclasses import replace

    words = lm_scoring.Words(pa.array(["a", "", "a b", "a b c d e", None, "a b c"]))
    turns = [lm_scoring.turn(words, k).tolist() for k in range(lm_scoring.ROUNDS)]
    assert sorted(sum(turns, [])) == list(range(len(words.hash)))
    df = table([(1, "lone pair")]).coalesce(1)
    vocabulary, _ = lm_scoring.fit(df)
    shared = spark.sparkContext.broadcast(replace(vocabulary, table=None))
    for phase in range(lm_scoring.ROUNDS):
        assert (lm_scoring.train_round(df, shared, lm_scoring.initial(), phase) != lm_scoring.initial()).any()


def test_lm_classes_grow_with_the_words():
    sizes = [lm_scoring.frequent_words(1 << k) for k in (10, 15, 20, 30)]
    assert sizes[0] == sizes[1] == lm_scoring.FREQUENT and sizes[1] < sizes[2] < sizes[3]


def cheapest(roles):
    """The least cost by trying every sequence of steps."""
    best = {chat_format.START: 0}
    for role in roles:
        now = {}
        for state, cost in best.items():
            for step in chat_format.steps(state, role):
                now[step[1]] = min(now.get(step[1], 1 << 30), cost + step[0])
        best = now
    return min(best.values())


@pytest.mark.parametrize("segment", [1, 2, 100])
def test_chats_of_all_short_role_sequences(spark, segment):
    names = ["system", "user", "assistant", None]
    every = [c for n in range(1, 5) for c in itertools.product(names, repeat=n)]
    rows = [(i, t, role, f"{i}.{t}") for i, c in enumerate(every) for t, role in enumerate(c)]
    got = chat_format.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), segment).collect()
    chats = {}
    for r in sorted(got, key=lambda r: (r["conv_id"], r["piece"])):
        chats.setdefault(r["conv_id"], []).append(r)
    for i, c in enumerate(every):
        state, turn, cost = chat_format.START, -1, 0
        for r in chats[i]:
            role = chat_format.ROLES.index(r["role_out"])
            if r["out_turn"] != turn:
                assert role in chat_format.NEXT[state] and r["out_turn"] == turn + 1
                state, turn = role, r["out_turn"]
            assert role == state
            cost += chat_format.COST.get(r["action"], 0)
        assert cost == chats[i][0]["conv_cost"] == cheapest([chat_format.role_number(x) for x in c])
        text = "".join(r["rendered"] for r in chats[i])
        assert all(f"{i}.{t}" in text for t in range(len(c))) and text.endswith("<|end|>\n")
        assert text.count("<|end|>") == turn + 1


def test_odd_chats(spark):
    rows = [(1, 0, "user", "a", 1), (1, 0, "user", "a", 1), (None, 3, "bot", None, 1), (None, None, None, "x", 1), (2, 5, "ASSISTANT ", "y", 1)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, segment int")
    got = chat_format.format_chats(df).collect()
    assert sorted((r["conv_id"] or 0, r["action"]) for r in got) == [
        (0, "relabel"), (0, "relabel"), (1, "keep"), (1, "merge"), (2, "empty"), (2, "insert")]
    assert chat_format.format_chats(df.filter("false")).count() == 0


def test_fingerprints_on_documents(docs, texts):
    got = {r["doc_id"]: r for r in fingerprints(docs).collect()}
    bits = lambda x, y: bin(int(x, 16) ^ int(y, 16)).count("1")
    for k, (i, text) in enumerate(texts):
        j, after = texts[(k + 1) % len(texts)]
        half, r = len(text) // 2, got[i]
        edited = text[: len(text) - half] + after[:half]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(1 - bits(r["fingerprint"], r["edited_fingerprint"]) / 128)
        assert r["near_next"] == pytest.approx(1 - bits(r["fingerprint"], got[j]["fingerprint"]) / 128)
        want = sum(bits(r["fingerprint"], o["fingerprint"]) <= 3 for o in got.values()) if i % 50 == 0 else None
        assert r["n_near"] == want
    assert len({t for _, t in texts}) >= len({r["fingerprint"] for r in got.values()})
    by_text = {}
    assert all(by_text.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"] for i, t in texts)
    assert np.mean([r["near_edited"] > r["near_next"] for r in got.values()]) > 0.9


def test_fingerprint_bits_are_majorities(spark, table):
    """A text of one word pair has its term's hash as fingerprint."""
    r = fingerprints(table([(1, "lone")])).first()
    a = spark.range(1).select(F.xxhash64(F.xxhash64(F.lit("lone")), F.lit(None).cast("bigint")).alias("t")).select(
        F.lower(F.lpad(F.hex("t"), 16, "0")), F.lower(F.lpad(F.hex(F.xxhash64(F.lit(1), "t")), 16, "0"))).first()
    assert r["fingerprint"] == a[0] + a[1]


def test_fingerprints_of_odd_rows(table, odd_rows):
    got = fingerprints(table(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    assert all(r["fingerprint"] == "0" * 32 for r in got if r["doc_id"] in (1, 2, 3))
    assert fingerprints(table([])).count() == 0


def test_radius_search_finds_all(spark):
    rng = np.random.default_rng(2)
    prints = {"%032x" % int.from_bytes(rng.bytes(16), "big") for _ in range(30)}
    for p in list(prints):
        for n in (1, 2, 3, 4, 5):
            flips = rng.choice(128, n, replace=False)
            prints.add("%032x" % (int(p, 16) ^ sum(1 << int(f) for f in flips)))
    prints = sorted(prints)
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint string")
    got = {(r["fingerprint"], r["found"]) for r in within(df, df, 3).collect()}
    assert got == {(x, y) for x in prints for y in prints if bin(int(x, 16) ^ int(y, 16)).count("1") <= 3}


def test_raking_meets_the_targets(spark):
    rows = [(s, l, t, n) for (s, l, t), n in zip(itertools.product("abc", "xy", "pq"), [900, 40, 300, 70, 500, 60, 80, 20, 40, 300, 10, 90])]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens bigint")
    from postlens.llm.common import Scratch

    part, temper = 0.3, {"source": 0.7, "lang": 0.7, "topic": 1.0}
    got = mixing.rake(cells, Scratch(spark, "t"), part, temper).collect()
    total = sum(r[3] for r in rows)
    for k, m in enumerate(mixing.MARGINS):
        own = {}
        for r in rows:
            own[r[k]] = own.get(r[k], 0) + r[3] / total
        scale = sum(v ** temper[m] for v in own.values())
        for v, share in own.items():
            weight = sum(r["weight"] for r in got if r[m] == v)
            assert weight == pytest.approx(share ** temper[m] / scale * part * total, rel=1e-3)
    assert all(0 <= r["probability"] <= 1 for r in got)


def test_mixing_of_odd_rows(table, odd_rows):
    df = table(odd_rows, lang=None, source=None)
    got = mixing.mix(df).collect()
    assert len(got) == len(odd_rows) and {r["source"] for r in got} == {"(none)"}
    left = mixing.draw_mixture(df)
    assert left.columns == df.columns and left.count() == sum(r["selected"] for r in got)
    assert mixing.mix(table([])).count() == 0


def test_octets_with_very_many_zeros():
    zeros = "0" * 6000
    assert pii.plain_spans(f"{zeros}1.2.3.4 x") == [("ip", 0, 6007)]
    assert pii.plain_spans("7" * 50_000) == []
    assert pii.plain_spans("1.2.3.4.5.6.7.8") == [("ip", 0, 7), ("ip", 8, 15)]


@pytest.mark.parametrize("unit", ["a", "a@", " ", "a at ", "a.", "1 ", "1", "+1 ", "QUJD+/", "[ ", "one ", "a@b.", "@ "])
def test_personal_data_in_very_long_runs_takes_linear_time(unit):
    def seconds(n):
        text = "’" + unit * (n // len(unit)) + "@ "
        began = time.process_time()
        pii.find(text)
        return time.process_time() - began

    seconds(1000)
    assert seconds(800_000) < 24 * max(seconds(100_000), 0.02)  # 64 times if it were quadratic


def test_addresses_are_read_outwards_from_their_sign():
    found = pii.find("a.b at c dot d dot org, x [at] y.net; at the dot; e  @ f.com’")[1]
    assert found == [("email", 0, 22), ("email", 24, 36), ("email", 50, 60)]
    assert pii.plain_spans("a@b@c.d@e.f") == [("email", 2, 7)]
