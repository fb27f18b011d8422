import pytest


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls, blanks, ties, repeated rows, a very long text, and extra columns that clash with inner names."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"),
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"),
        (2, None),
        (3, ""),
        (4, " \n\t "),
        (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"),
        (None, None),
        (5, "word " * 60_000),
        (6, "é ñ 漢字 😀 don't 12.5%"),
        (-7, "one"),
    ]
    clash = "fp long, row string, ids string, k string, t string, n int, y int, ws string, pos int, term int, votes string, key string, rank int"
    return spark.createDataFrame([(*r, None, "r", "i", "k", "t", 1, 0, "w", 2, 3, "v", "z", 4) for r in rows], f"doc_id long, text string, {clash}")


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def read(spark, data):
    return lambda name: spark.read.parquet(f"{data}/{name}.parquet")
