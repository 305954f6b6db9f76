import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True, scope="session")
def workers(spark):
    """Python workers import the package from where the tests do."""
    from postlens.llm.queries import importable

    importable(spark)


@pytest.fixture(scope="session")
def table(spark):
    """A documents table from (doc_id, text) pairs, with columns that clash with inner names."""

    def make(rows, lang="en", source="s"):
        full = [(i, t, lang, source, None if t is None else len(t), 1, "x", "y") for i, t in rows]
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, `row` int, name string, bucket string"
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empties, ties, repeats and a very long text."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One Two"), (5, "One Two"), (None, "one two"),
        (7, long), (8, long + " end"), (9, "ÄÖ ß 日本語 " * 30), (10, "ÄÖ ß 日本語 " * 30), (11, "12 34 --"),
    ]
