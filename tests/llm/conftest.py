import duckdb
import pytest


@pytest.fixture
def duck():
    return duckdb.connect()


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a documents table from texts, numbered from 0, or from (doc_id, text) pairs."""

    def make(texts, start=0):
        rows = [t if isinstance(t, tuple) else (start + i, t) for i, t in enumerate(texts)]
        full = [(i, t, ("en", "de", None)[k % 3], f"src{k % 12}" if k % 7 else None, None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, DOCS)

    return make
