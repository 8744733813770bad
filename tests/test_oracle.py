"""Every query that SQL can express, against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from larchspan import plans
from tests.comparing import duck, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_sql(spark, connection, name):
    same(plans.QUERIES[name](spark, SF), connection, plans.ORACLE[name])


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
