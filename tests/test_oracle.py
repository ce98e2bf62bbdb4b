import pytest

from tests.compare import from_spark, from_sql, rows
from tidemark.plans import queries as plans

NAMES = list(plans.queries())


def test_each_query_has_sql():
    assert set(plans.oracle_sql()) == set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, sf_dir, name):
    got = from_spark(plans.queries()[name](spark, sf_dir))
    want = from_sql(plans.oracle_sql()[name], sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
