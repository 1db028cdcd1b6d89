import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, kept string, node long, size int"


@pytest.fixture
def documents(spark):
    """Makes a documents table (with columns whose names clash with the operators' own) from (doc_id, text, lang, source)."""

    def make(rows):
        return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t), "x", 1, 2) for i, t, lang, source in rows], DOCUMENTS)

    return make


@pytest.fixture
def rows_of():
    return lambda df, *key: {tuple(r[k] for k in key) if len(key) > 1 else r[key[0]]: r for r in df.collect()}
