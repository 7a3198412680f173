import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from seqloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", 4)


def sequences_of(spark, table, kind="string"):
    """A sequence frame from ``{seq_id: items}``."""
    rows = [(s, (i,), x) for s, items in table.items() for i, x in enumerate(items, 1)]
    item = {"string": "string", "frame": "array<double>"}[kind]
    return spark.createDataFrame(rows, f"seq_id long, ord struct<n:int>, item {item}")
