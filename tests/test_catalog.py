"""Every query against its SQL; those without SQL must run and keep their columns."""

import pytest
from compare import same

from chronovec.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, duck, sf_dir, name):
    same(catalog.QUERIES[name](spark, sf_dir), duck.execute(catalog.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    assert df.columns and len(df.collect()) > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
