from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from kerbstat.session import local_session, stage  # noqa: E402
from kerbstat.sources.tpch import citations_from_tpch  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", **{"spark.driver.memory": "6g", "spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def citations(spark):
    return stage(citations_from_tpch(spark, SMALL), "citations")


@pytest.fixture
def conf(spark):
    """Set session settings for one test."""
    before = {}

    def set_(key: str, value: str) -> None:
        before.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)

    yield set_
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)
