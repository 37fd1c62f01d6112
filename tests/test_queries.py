"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

from __spark_entry__ import entry
from noteweave.plans.oracles import ORACLES
from noteweave.plans.queries import QUERIES
from tests.compare import difference

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables not present")


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@needs_tables
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    assert difference(spark, FOLDER, name) is None


@needs_tables
def test_flagship_runs(spark):
    table = entry(spark)
    assert table.count() == 50 and "content" in table.columns
