import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, score double"


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with columns whose names clash with results."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, -1, "x", 9.0) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


LONG = "word " * 30_000
#: Null and empty texts, white space, a very long text, ties and repeated rows, a null id.
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "a b c"), (5, "a b c"), (None, "a b c d e f g"), (6, "é É ß 日本 İ"), (7, None), (-8, "token = 'abcdefgh12345678'")]


@pytest.fixture
def edge(docs_of):
    return docs_of(EDGE)
