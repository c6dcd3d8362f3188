"""The numbered queries that SQL can express, side by side with it."""

import compare
import pytest
from helixframe.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, sf, name):
    rows = registry.queries()[name](spark, sf).toPandas()
    assert compare.differences(rows, compare.database(sf).execute(registry.oracle_sql()[name]).df()) == ""
