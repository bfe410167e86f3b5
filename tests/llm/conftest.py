import pytest

TEXTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (doc_id, text) pairs, with columns of clashing names beside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1) for i, t in rows], TEXTS + ", component_id string, score int")

    return make
