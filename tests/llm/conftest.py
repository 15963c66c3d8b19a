import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with names the operators use."""

    def make(rows, **more):
        rows = [(i, t, None, "s", len(t or ""), 7, "x") for i, t in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n int, kept string")

    return make
