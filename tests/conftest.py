import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from perimetra.session import configured, ship  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        configured(SparkSession.builder.master("local[8]").appName("tests"))
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def close(a, b, tol=1e-9):
    if isinstance(a, float) or isinstance(b, float):
        return a is None and b is None or abs(a - b) <= tol * max(1.0, abs(b))
    return a == b


def same(a, b, tol=1e-9):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(close(p, q, tol) for p, q in zip(x, y)), (x, y)
