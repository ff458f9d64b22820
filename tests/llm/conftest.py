import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (id, text) pairs, with other columns, one of a name that operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in rows], DOCS).selectExpr("*", "'x' AS shingles", "1 AS class", "2 AS score", "3 AS start", "4 AS row", "5 AS key")

    return make


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path
