import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, shard string, _row string, taken int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows and extra columns whose names clash."""
    long_text = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))
    base = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old tree near the river bank"
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base.upper() + " ", "en", None),
        (4, base + " today", "en", "b"), (5, None, "en", "b"), (6, "", "en", "a"), (7, " \t\n", "de", "c"), (8, "single", None, "c"),
        (9, long_text, "en", "a"), (10, long_text + " end", "en", "a"), (None, "row without id here", "en", "d"),
        (None, None, None, None), (11, "été 漢字 \U0001f600 password=abcdef123456", "fr", "d"), (2, "another text under the same id", "en", "a"),
        (12, "1234 5678 !!", "en", "b"), (-5, "negative id and\x00null byte", "en", "b"),
    ]
    return spark.createDataFrame([(*r, len(r[1]) if r[1] else None, "x", "y", "z", "r", 3) for r in rows], DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
