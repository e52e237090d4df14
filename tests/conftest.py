import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from moodlens.session import get_spark  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", app="moodlens-tests", **{"spark.sql.shuffle.partitions": "8"})
    yield s
    s.stop()


@pytest.fixture(scope="module", autouse=True)
def nothing_stays_cached():
    """Frames that a module's tests persisted would stand in the plans of the next."""
    yield
    if session := SparkSession.getActiveSession():
        session.catalog.clearCache()


def post(pid, author="a1", text="", tags=(), created="2021-03-01T10:00:00.000Z", lang="en"):
    """One POST row as a tuple for createDataFrame(schema=POST)."""
    rules = None if tags is None else [(str(i + 1), t) for i, t in enumerate(tags)]
    return ((pid, author, created, text, lang), rules)


def user(uid, created="2018-05-01", verified=False, followers=10):
    return (uid, created, verified, (followers,))
