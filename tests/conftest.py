import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for path in (ROOT, os.path.dirname(os.path.abspath(__file__))):
    if path not in sys.path:
        sys.path.insert(0, path)


@pytest.fixture(scope="session")
def spark():
    from cellwright.session import local_session

    session = local_session(8, shuffle_partitions=4, app="tests")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """A text table from lists, with row numbers."""

    def make(columns, rows):
        schema = ", ".join(["_row bigint", *[f"`{c}` string" for c in columns]])
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)

    return make
