"""Documents with the cases that every operator has to stand."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977} x{i}" for i in range(20_000))
ROWS = [
    (1, "the cat sat on the mat and looked at the moon for a while", "en", "a", 57),
    (2, "the cat sat on the mat and looked at the moon for a while", "en", "a", 57),
    (2, "the cat sat on the mat and looked at the moon for a while", "en", "a", 57),
    (3, None, "en", "b", None),
    (4, "", None, None, 0),
    (5, " \n\t ", "de", "b", 4),
    (6, LONG, "en", "a", len(LONG)),
    (7, "der Hund läuft über die Straße", "de", "b", 30),
    (None, "a text without an id", "en", None, 20),
    (9, "one", "en", "c", 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, very long and repeated texts, null ids and sources."""
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def crowded(odd):
    """The same rows with columns named like those the operators add."""
    names = ("size", "hash", "fp", "key", "host", "rule", "score", "fingerprint", "k", "copy",
             "bad", "own", "kept", "target")
    df = odd
    for name in names:
        df = df.selectExpr("*", f"'x' as {name}")
    return df


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.limit(0)
