import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, key string, id long, spans string"


@pytest.fixture
def documents(spark):
    """Makes a documents table of texts, with columns whose names clash with the operators' own."""

    def make(texts, ids=None, langs=None):
        ids = list(range(len(texts))) if ids is None else ids
        langs = ["en"] * len(texts) if langs is None else langs
        return spark.createDataFrame([(i, t, k, "src", None if t is None else len(t), "k", 7, "x") for i, t, k in zip(ids, texts, langs, strict=True)], DOCUMENTS)

    return make
