import pytest

#: Texts that every operator must take: null, empty, blank, short, repeated, odd characters, very long.
LONG = " ".join(f"word{i % 977} runs{i % 13}." for i in range(60_000))
TEXTS = [None, "", " \n\t ", "one", "one", "two words", "a b c ὠ0 \x1c x", "the quick brown fox jumps over the lazy dog. " * 30, "!!! ### $$$ | | | |", LONG]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents with extra columns whose names clash with those that operators use, and a repeated row."""
    rows = [(i, t, "x", 1, "k", 0.5) for i, t in enumerate(TEXTS)] + [(3, "one", "x", 1, "k", 0.5), (None, "null key", "x", 1, "k", 0.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, digest int, kept string, rate double")


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
