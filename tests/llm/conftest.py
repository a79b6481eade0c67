import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, keep_id string, ids int"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text), with extra columns whose names operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, "xx", None, None, "f", "k", 1) for i, t in rows], DOCS)

    return make


EDGES = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "a"), (5, "a"), (None, "a"), (6, "one two"), (7, "é ß 漢字 😀 \x00 ▁ </s>"),
    (8, "word " * 3000), (9, "x" * 20_000), (-3, "the same text stands here, long enough to be a passage of fifty bytes"),
    (10, "the same text stands here, long enough to be a passage of fifty bytes"), (11, "..."),
]


@pytest.fixture
def edges(documents):
    return documents(EDGES)
