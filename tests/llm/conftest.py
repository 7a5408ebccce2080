import pytest

#: A document's columns, and further ones whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place long, part int, score double, label string, blob int, ids string"


def doc(doc_id, text, lang="en"):
    return (doc_id, text, lang, "s", None if text is None else len(text), 7, 3, 0.5, "l", 1, "i")


@pytest.fixture(scope="session")
def documents(spark):
    """A function that makes a table of documents from (doc_id, text) rows."""

    def make(rows):
        return spark.createDataFrame([doc(*r) for r in rows], SCHEMA)

    return make
