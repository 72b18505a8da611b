import pytest

KINDS = "doc_id long, text string, lang string, source string, n_chars long, _id string, _len int"


@pytest.fixture
def frame(spark):
    """documents with two extra columns whose names clash with inner ones."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, None, "x", 1) for i, t, s in rows], KINDS)

    return make
