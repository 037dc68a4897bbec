import pytest


@pytest.fixture
def docs_of(spark):
    """documents rows (doc_id, text, lang, source, n_chars) from (doc_id, text) pairs."""

    def make(rows, lang="en"):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        return spark.createDataFrame([(i, t, lang if isinstance(lang, str) else lang[n], "s", len(t or "")) for n, (i, t) in enumerate(rows)], schema)

    return make
