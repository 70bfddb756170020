import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, quality int, repeats int, u long, h long, n long, c long, key string, shard int"


def words(n, start=0):
    return " ".join(f"word{(i * 7919 + start) % 4801}{'.' if i % 9 == 8 else ''}" for i in range(n))


LONG = words(60_000)
BASE = words(120, 5)
PASSAGE = words(80, 900)


def odd_rows():
    """Nulls in every column, empty and blank texts, a long text, ties, repeated rows, near and exact copies."""
    near = BASE.split()
    near[60] = "changed"
    texts = [
        (1, BASE), (2, BASE), (3, " ".join(near)), (4, None), (5, ""), (6, " \t\n "), (7, LONG), (8, "One two three."), (9, "one  TWO\nthree."),
        (10, "é ü ß " * 70 + PASSAGE), (11, "ein anderer Text " * 5 + PASSAGE + " und ein Schluss"), (12, BASE), (12, BASE), (None, "A lonely row."), (None, None),
        (13, "same same same " * 40), (14, "Home | About | Contact | Help\n" * 30), (15, "12345 67890"),
    ]
    return [(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"src{k % 3}", None, 0, 1, 2, 3, 4, 5, 6, "k", 7) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3, F.col("n_chars"), F.col("doc_id"))


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
