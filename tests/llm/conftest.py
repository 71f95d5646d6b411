import pytest


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text) as a table with the columns of `documents` and one that clashes with inner names."""

    def make(rows, parts=3):
        full = [(*r, "en", "src0", len(r[1] or ""), "x") if len(r) == 2 else (r[0], r[1], "en", r[2], len(r[1] or ""), "x") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, label string").repartition(parts)

    return make
