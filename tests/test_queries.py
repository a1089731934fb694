import pytest

from isoflow.plans import registry
from tests.conftest import TESTDATA, rows_of


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.queries()[name](spark, f"{TESTDATA}/sf0.01").toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    missing = want.astype(object).where(want.notna(), None)
    assert rows_of(got) == rows_of(missing)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, f"{TESTDATA}/sf0.01").count() > 0


def test_entry_imports_without_the_llm_part():
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship_query_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
