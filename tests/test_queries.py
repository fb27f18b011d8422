"""Every registered query against its SQL."""

import pytest

from scriptorium import plans

ORACLE = plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(name, same):
    same(plans.queries()[name], ORACLE[name])


def test_every_query_has_sql():
    assert set(plans.queries()) == set(ORACLE)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
