"""Every registered query of the core against its SQL; the others must run."""

import oracle
import pytest

from bipartia.plans import associations, inputs, problems

QUERIES = {**problems.QUERIES, **associations.QUERIES, **inputs.QUERIES}
SQL = {**problems.SQL, **associations.SQL, **inputs.SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, name):
    oracle.compare(spark, sf, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_names():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(QUERIES) <= set(__spark_entry__.queries())
