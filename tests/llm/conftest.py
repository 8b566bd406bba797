import pytest

from brute import frame, made_texts


@pytest.fixture(scope="session")
def rows():
    return [(i, t) for i, t in enumerate(made_texts())]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, and rows that repeat an id and a text or an id alone."""
    text = " ".join(f"w{i}" for i in range(60))
    return frame(spark, [(None, "a b"), (None, None), (3, text), (3, text), (3, "other"), (5, text), (None, text)])


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
