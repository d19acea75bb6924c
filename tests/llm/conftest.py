import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, h long, name string, node long, root long, label string, chunk long, key double, kept boolean, copies int, rid long, v string"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text[, source]) with extra columns whose names the operators use inside."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, 1, 2, "n", 3, 4, "l", 5, 0.5, True, 1, 6, "v") for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return make


@pytest.fixture(scope="session")
def awkward():
    """Null, empty, blank and very long texts, ties and repeated rows, null ids."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    return [
        (1, "the quick brown fox"), (2, "the quick brown fox"), (3, None), (4, ""), (5, " \n\t "), (6, long), (7, long + " tail"), (8, "The Quick BROWN fox"),
        (9, "a"), (9, "a"), (10, "é漢字 😀 ß"), (None, "no id"), (None, None), (11, "x" * 5000), (12, "the quick brown fox "),
    ]
