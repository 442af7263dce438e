import pytest

from barloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", cores=4, shuffle_partitions=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    return s


def rows(df):
    """Rows as a sorted list of tuples, nulls last."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
