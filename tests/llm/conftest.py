import pytest


@pytest.fixture
def docs(spark):
    """documents from (doc_id, text) pairs, with the other columns of the table and one whose name clashes."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, node string")

    return make


#: Nulls, empty and blank texts, a repeated row, ties, a long text.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "one two"), (5, "a b c d e f g " * 3000), (6, "ONE"), (7, "é ü x")]


@pytest.fixture
def odd(docs):
    return docs(ODD)
