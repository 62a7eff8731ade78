import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, code string, node long, tie string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, and columns with clashing names."""
    long = " ".join(f"wort{i} und der die das" for i in range(9000))
    rows = [
        (1, "Der Hund läuft über die Straße und bellt laut.\nZweite Zeile hier.", "de", "a", 60),
        (1, "Der Hund läuft über die Straße und bellt laut.\nZweite Zeile hier.", "de", "a", 60),
        (2, "The dog runs over the street and barks loudly.\nSecond line here.", "en", "b", None),
        (3, None, "en", "a", 0),
        (4, "", "de", None, 0),
        (5, " \n\t\n ", None, "b", 5),
        (6, long, "de", "b", len(long)),
        (7, "12345 67/89 ---", "en", "a", 15),
        (None, "A text without an id that is long enough to count.", "en", "a", 50),
        (8, "😀 漢字 ab", None, None, None),
    ]
    return spark.createDataFrame([r + (0, "x", 1, "t") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
