import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts or (doc_id, text) pairs, with columns whose names operators use inside."""
    def make(rows, langs=None, sources=None):
        out = []
        for i, r in enumerate(rows):
            doc_id, text = r if isinstance(r, tuple) else (i, r)
            out.append((doc_id, text, langs[i] if langs else "en", sources[i] if sources else "src0",
                        len(text) if text is not None else None, "x", i, 0.5, b"k"))
        return spark.createDataFrame(out, COLUMNS + ", id string, row long, score double, key binary")
    return make


LONG = "one very long line of words " * 20000
