import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from pagesearch.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, shuffle_partitions=4)


@pytest.fixture
def one(spark):
    """Evaluate a column expression over one row given as keyword values."""
    def evaluate(expression, **values):
        row = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"])
        return row.select(expression.alias("out")).first().out

    return evaluate
