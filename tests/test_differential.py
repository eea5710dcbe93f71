"""Every core query against its SQL at the smallest scale, and plans without Python or Cartesian products."""

import re

import pytest
from differential import connect, difference

from skyloom.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
#: A fold over sorted messages, which no built-in expression does in bounded memory, archives, which tasks parse, and prefix sums of tiles.
PYTHON = {"rate_limit_events", "archive_netcdf", "archive_numpy", "archive_slice", "archive_headers", "model_outputs_written", "parameter_count", "window_unmasked"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert difference(df, con, ORACLE_SQL[name]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct" if name in PYTHON else "Python|Pandas|InArrow|CartesianProduct", plan), plan


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
