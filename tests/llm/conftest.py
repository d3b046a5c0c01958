import pytest

LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, blanks, a very long text, repeats, and columns whose names an operator might use itself."""
    words = " ".join(f"p{i}" for i in range(80))
    rows = [(1, words, "en"), (2, words + " tail", None), (2, words + " tail", None), (3, None, "de"), (4, "", "en"), (5, "  \n\t ", "en"), (6, LONG, "en"), (7, LONG, "fr"), (None, words, "en"), (8, "one two", "en"), (9, "ONE  two", "en"), (10, "a\nb\nc\nd\na\nb\nc", "en"), (11, "z\na\nb\nc", "en")]
    return spark.createDataFrame([(*r, "x", 7, [1], "mine", 1, 2, 3, [4], True, [5], "s", 6, "r", 8) for r in rows], "doc_id long, text string, lang string, label string, n long, ids array<int>, keep string, hits int, start int, __id int, __at array<int>, __whole boolean, __starts array<int>, __spans string, part int, rep string, own_0 int")


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)


@pytest.fixture(scope="session")
def pairs(odd):
    """doc_id and text of the rows that have an id, one of each."""
    return sorted({(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None}, key=lambda x: x[0])
