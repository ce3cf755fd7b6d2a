import pytest

#: Null, empty, blank and one-word texts, a long one, repeated rows, and names that operators use inside.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog again and again today", "a", 1), (2, None, "b", 2), (3, "", "c", 3), (4, "   \n\t ", "d", 4),
    (5, "word", "e", 5), (6, "the quick brown fox jumps over the lazy dog again and again today", "f", 6), (6, "the quick brown fox jumps over the lazy dog again and again today", "f", 6),
    (None, "no id here but some words all the same", "g", 7), (8, "long words " * 20_000, "h", 8), (9, "Éa 日本語 \U0001f600 mixed", "i", 9),
]
DDL = "doc_id long, text string, id string, size int"


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DDL)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DDL)
