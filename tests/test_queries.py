"""Every registered query equals its reference SQL on the smallest data."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import ROOT, check, connect

SF = os.environ.get("TEST_SF", "0.001")
FOLDER = f"{ROOT}/sf{SF}"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    ok, message = check(spark, con, entry.queries()[name], entry.oracle_sql().get(name), FOLDER)
    assert ok is not False, message


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["feature_date", "segment", "companies", "events", "event_rate", "mean_duration"]
    assert df.count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
