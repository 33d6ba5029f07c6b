"""Every query of the library against its own SQL."""

import pytest

from corpusengine.plans import registry
from tests.compare import same


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, small, name):
    same(spark, registry.QUERIES[name], registry.SQL[name], small)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_has_rows(spark, small, name):
    assert registry.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
