import pytest

#: edge rows: NULL and empty texts, ties, repeated rows, a long text, and NULL ids, languages and sources
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank, and then it sleeps.", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank, and then it sleeps.", "en", "a"),
    (3, None, "en", None), (4, "", None, "a"), (5, " \t\n ", "en", "b"), (6, LONG, "de", "b"),
    (7, "one", "fr", "b"), (7, "one", "fr", "b"), (None, "no id but text", None, None), (None, None, None, None),
    (8, "mail bob.smith@mail.example.org or +1 (988) 555-2485, card 4539 1488 0343 6467 from 10.0.0.255", "en", "a"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Edge rows with extra columns whose names the operators use inside."""
    df = spark.createDataFrame([(*r, 0, "x", "y", 1) for r in ROWS],
                               "doc_id long, text string, lang string, source string, n_chars long, t string, fp string, k int")
    return df.repartition(3)


@pytest.fixture(scope="session")
def none(spark, edge):
    return spark.createDataFrame([], edge.schema)
