import pytest


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with ids from 0 in the given order, and columns whose names could clash."""

    def make(texts):
        rows = [(i, text, "en", "src0", len(text) if text is not None else None, 7) for i, text in enumerate(texts)]
        return spark.createDataFrame(
            rows, "doc_id long, text string, lang string, source string, n_chars long, score int"
        )

    return make
