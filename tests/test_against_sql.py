"""Every query of the library gives the rows of its SQL. The corpus operators' queries are tested in tests/llm."""

import pytest

from __spark_entry__ import entry, queries
from checks.compare import differences
from checks.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, sf, name):
    assert differences(spark, sf, QUERIES[name], ORACLES[name]) is None


def test_queries_are_registered():
    assert set(QUERIES) <= set(queries())


def test_entry_has_rows(spark):
    assert entry(spark).columns == ["developer", "year", "total_items", "free_percentage"]
    assert entry(spark).count() > 0
