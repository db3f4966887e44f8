import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, score string, n_words string, component_id string, block int, id string, key string, label string, n_tokens string, kept string"


def rows(texts, first=0):
    return [(first + i, t, "en", "s", 0 if t is None else len(t), "x", "x", "x", "x", 7, "x", "x", "x", "x", "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, a very long one, ties, repeated rows and ids, other
    columns with names that operators use."""
    long_text = " ".join(f"word{i % 997} thing{i % 13}" for i in range(60_000))
    texts = ["", None, "  \n\t ", "one", "one two", "a b c d e f g", "a b c d e f g", "A B C d e f g", long_text, long_text + " more", "x" * 50_000, "é😀   ▁ <|endoftext|>\r\n\x00 end"]
    made = rows(texts)
    made += [made[5], made[5], (None, "a b c d e f g", *made[0][2:]), (None, None, None, None, None, *made[0][5:])]
    return spark.createDataFrame(made, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(12)] + [(None, 1, 1), (3, None, None), (4, 7, -1), (5, 0, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
