import pytest


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text[, lang, source]) rows, with columns whose names clash with inner ones."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, len(r[1] or ""), 7, "x") for r in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long, fp int, component_id string"
        )

    return make
