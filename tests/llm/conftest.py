import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Wörter und mehr words " * 6000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and extra columns with clashing names."""
    rows = [
        (5, "Hello  World", "en", "a", 12), (3, "HelloWorld", "en", "a", 10), (9, "He llo\tWorld", None, None, None),
        (1, None, "en", "b", None), (2, "", "de", "b", 0), (7, " \n\t", "de", None, 3), (None, "no id here", "fr", "c", 10),
        (None, None, None, None, None), (11, LONG, "de", "c", len(LONG)), (12, LONG + "x", "de", "c", 1), (4, "same row", "en", "a", 8),
        (4, "same row", "en", "a", 8), (6, "über größe İ \U0001f600 é", "de", "a", 5), (13, "a b", "en", "b", 3),
        (-2, "<|endoftext|> mark\r\nnext  line", "en", "b", 3),
    ]
    wide = DOC_SCHEMA + ", size long, target double, digest string, row string, shard int, copies long, fp long, n int"
    return spark.createDataFrame([(*r, 1, 2.0, "d", "r", 3, 4, 5, 6) for r in rows], wide)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
