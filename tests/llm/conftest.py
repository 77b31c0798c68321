import pytest


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows, a repeated doc_id, extra columns."""
    copy = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(0, None, "en", "a"), (1, "", None, None), (2, " \t\n", "en", "a"), (3, copy, "en", "a"), (4, copy, "de", None),
            (4, copy, "de", None), (None, copy + " x", "en", "a"), (5, "few words", "en", "a"), (6, "few words", "en", "a"),
            (6, "FEW words", "en", "b"), (7, "word" * 20_000, "en", "a"), (8, "a b c " * 5_000, "en", "a"),
            (None, None, None, None), (9, "<|endoftext|> héllo ΣΑΣ 漢字 \x1c\x85 it's", "fr", "b")]
    return spark.createDataFrame([(*r, "extra", 1) for r in rows],
                                 "doc_id long, text string, lang string, source string, node string, n int")


@pytest.fixture(scope="module")
def no_docs(odd_docs):
    return odd_docs.limit(0)
