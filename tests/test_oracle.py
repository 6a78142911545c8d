"""Every query with SQL against DuckDB on the smallest tables."""

import pytest

from kelpline.plans.registry import ORACLE_SQL, QUERIES
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    assert name in ORACLE_SQL
    assert compare(QUERIES[name](spark, SF), ORACLE_SQL[name], SF) == ""


def test_entry_points_run_without_and_with_the_training_data_queries(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1
