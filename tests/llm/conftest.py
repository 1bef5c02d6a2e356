import pytest


def bits(rows):
    return sorted(tuple(r) for r in rows)


@pytest.fixture
def docs_of(spark):
    """documents with clashing extra columns, from (doc_id, text) or (doc_id, text, source)."""

    def make(rows):
        rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 1, 0.5) for r in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rank int, score double")

    return make
