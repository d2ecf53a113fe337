import pytest

LONG = "lorem ipsum dolor sit amet " * 40_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs in any column, empty and very long texts, repeated rows, an id used twice, extra columns that operators use themselves."""
    rows = [
        (1, "one two three four five six seven eight nine ten eleven.", "en", "a"), (1, "one two three four five six seven eight nine ten eleven.", "en", "a"),
        (2, None, "en", "a"), (3, "", None, "a"), (4, " \n\t ", "de", None), (5, LONG, "en", "b"), (None, "a text without an id, long enough to count for something here.", "en", None),
        (1, "the same id with another text, which is a document of its own.", None, "b"), (None, None, None, None),
    ]
    rows = [(*r, 0, 1.5, "x", 7, 7) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, rate string, size int, node int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("doc_id = -1")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def small(spark):
    return "/root/testdata/sf0.001"
