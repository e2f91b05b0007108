import pytest

import __spark_entry__ as entry
from tremorlens.plans import evaluation


@pytest.mark.parametrize("name", sorted(evaluation.QUERIES))
def test_query_equals_sql(name, same):
    same(evaluation.QUERIES[name], evaluation.SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
