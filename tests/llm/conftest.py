import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, anchor string, n long"


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, copies, repeated rows, further columns with clashing names."""
    body = " ".join(f"word{k % 97} tion{k % 89}" for k in range(400))
    rows = [
        (1, None, "en", "a", None, 1, "x", 1),
        (2, "", None, None, 0, 1, "x", 1),
        (3, " \n\t ", "en", "a", 4, None, None, None),
        (4, "one two", "en", "a", 7, 1, "x", 1),
        (5, body, "en", "a", len(body), 1, "x", 1),
        (6, body, "fr", "b", len(body), 1, "x", 1),
        (7, body + " more words at the end", "en", None, 0, 1, "x", 1),
        (8, "ab " * 20000, None, "a", 60000, 1, "x", 1),
        (9, "Ünï çödé ß x 漢字 😀", "de", "a", 20, 1, "x", 1),
        (10, "12345 67890 $$$ %%%", "en", "a", 19, 1, "x", 1),
        (11, "ab " * 50, "en", "a", 150, 1, "x", 1),
        (4, "one two", "en", "a", 7, 1, "x", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where(F.lit(False))
