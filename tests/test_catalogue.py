"""Every query of the catalogue that SQL can express, against DuckDB."""

import parity
import pytest

from strandframe.plans import catalogue


@pytest.fixture(scope="module")
def con(sf):
    return parity.connect(sf)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_agrees_with_sql(spark, sf, con, name):
    df = catalogue.QUERIES[name](spark, sf)
    r = con.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in r.description]
    assert sorted(columns) == sorted(df.columns)
    assert parity.rows(df.columns, [tuple(x) for x in df.collect()]) == parity.rows(columns, r.fetchall())


# At this scale no bin of balanced_off_diagonal passes its least sum, so that no rows are right; test_balancing has dense matrices.
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) - {"balanced_off_diagonal"}))
def test_has_rows(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
