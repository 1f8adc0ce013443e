import pytest

from comparing import same
from millrace.plans import core_queries, detail_queries, more_queries, nested_queries

MODULES = (core_queries, detail_queries, more_queries, nested_queries)
ALL = {k: v for m in MODULES for k, v in m.queries().items()}
SQL = {k: v for m in MODULES for k, v in m.oracle_sql().items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, small, name):
    same(ALL[name](spark, small), duck.execute(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_query_without_sql_runs(spark, small, name):
    assert ALL[name](spark, small).count() > 0


def test_entry_runs_without_the_training_data_package(spark, small):
    import __spark_entry__ as entry

    assert set(ALL) <= set(entry.queries())
    assert entry.entry(spark).columns == ["raw_id", "node_path"]
