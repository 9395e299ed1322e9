import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from churnlens.session import local_session

    s = local_session(cores="4", shuffle_partitions=4, app="churnlens-tests")
    yield s
    s.stop()


def rows(df, order=None):
    """Collected rows as tuples, sorted (NULLs first) for comparison."""
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=lambda r: tuple((x is not None, str(type(x)), x if x is not None else 0) for x in r))
