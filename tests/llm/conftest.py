import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, start int, score int, host string, label int"


@pytest.fixture(scope="session")
def docs(spark):
    """documents with columns whose names clash with those of the operators."""
    def make(texts, ids=None, source="s"):
        rows = [(i if ids is None else ids[i], t, "en", source, None if t is None else len(t), "x", 1, 2, "h", None) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)
    return make


@pytest.fixture(scope="session")
def odd(docs):
    """Null, empty and very long texts, ties, repeated rows, a null key."""
    return docs([None, "", " \n ", "a", "word " * 40_000, "same text here of five words", "same text here of five words", "same text here of five words", "x" * 60_000], ids=[0, 1, 2, 3, 4, 5, 5, 6, None])
