import pytest

LONG = "lorem ipsum dolor sit amet consectetur " * 3000
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau upsilon"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash with results."""
    rows = [
        (1, "", "en", "x"), (2, None, None, "x"), (None, WORDS, "en", None), (None, None, None, None), (3, LONG, "fr", "y"), (4, WORDS, "en", "y"), (4, WORDS, "en", "y"),
        (5, WORDS.replace(" ", "\n"), "de", "y"), (6, "é́ ß 漢字 \U0001f600 '' 're  \x1c x" * 40, None, "z"), (7, " \t\n\x0b\x0c\r ", "es", "z"), (5, "other text of the same id", "en", "z"),
    ]
    rows = [(*r, "clash", True, 9, 8) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, keep_id string, kept boolean, shard int, rank int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
