import pytest


def same(got, expected):
    """Compares rows whatever their order, nulls and types included."""
    key = lambda row: tuple((v is None, str(v)) for v in row)
    got, expected = sorted(map(tuple, got), key=key), sorted(map(tuple, expected), key=key)
    assert got == expected, [pair for pair in zip(got, expected) if pair[0] != pair[1]][:5]


@pytest.fixture(scope="session")
def compare():
    return same


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make
