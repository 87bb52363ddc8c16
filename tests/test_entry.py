import pytest

import __spark_entry__ as entry
from quarry.plans import corpus_queries
from quarry.plans import queries as engine
from tests.oracle import SF, agree, there

pytestmark = pytest.mark.skipif(not there, reason="no test tables")


OWN = engine.queries() | corpus_queries.queries()
SQL = engine.oracle_sql() | corpus_queries.oracle_sql()


@pytest.mark.parametrize("name", OWN)
def test_query_agrees_with_its_sql(spark, name):
    agree(OWN[name](spark, SF), SQL[name])
    spark.catalog.clearCache()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) >= set(OWN)
    spark.catalog.clearCache()
