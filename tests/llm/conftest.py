import pytest

ROWS = "doc_id long, text string, lang string, source string, n_chars long, score double, size int, tokens string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with columns whose names clash with those the operators make."""
    def make(rows):
        return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 0.5, 1, "x") for i, t, lang in rows], ROWS)
    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Null ids and texts, empty and very long texts, repeated rows, repeated ids."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return make_docs([(1, "plain text of seven words or so", "en"), (2, "plain text of seven words or so", "en"), (2, "another text under the same id", None),
                      (3, None, "en"), (4, "", "de"), (5, " \n\t ", None), (None, "a null id", "en"), (None, None, None), (6, long, "en"), (7, "!!! ??? 12", "fr"),
                      (8, "twice the same row", "en"), (8, "twice the same row", "en")])


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
