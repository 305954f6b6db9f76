"""The pipeline against its stages' brute-force twins, and the registered queries."""

from test_dedup import exact, near

import corpus_pipeline
from postlens.llm import mixing
from postlens.llm.queries import ORACLES, QUERIES


def test_pipeline_keeps_what_the_twins_keep(spark, docs, texts):
    got = {r["doc_id"]: r["doc_tokens"] for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()}
    rows = [(i, t) for i, t in texts if any(c.isalpha() for c in t or "")]
    kept = {i for i, _, _, k, _ in exact(rows) if k}
    rows = [(i, t) for i, t in rows if i in kept]
    first = {i for i, _, c in near(rows) if c == i}
    left = docs.filter(docs.doc_id.isin(sorted(first)))
    drawn = {r["doc_id"] for r in mixing.mix(left).collect() if r["selected"]}
    assert set(got) == drawn and len(drawn) > 50


def test_stage_names_and_columns(spark, docs):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 1 + len(QUERIES)))
    assert set(ORACLES) <= set(QUERIES)
