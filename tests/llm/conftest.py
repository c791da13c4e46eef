import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Texts to a documents table with columns whose names clash with those that operators add."""

    def make(texts, ids=None, langs=None, sources=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, langs[k] if langs else "en", sources[k] if sources else "s", None if t is None else len(t), "mine", 7, True) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        return spark.createDataFrame(rows, COLUMNS + ", score string, size int, kept boolean").repartition(3)

    return make
