"""Rounded doubles are the SQL's to the last digit."""

import parity
import pytest

from strandframe.plans import catalogue

LARGER = "/root/testdata/sf0.01"


def exact(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(str(r[k]) for k in order) for r in data)


def agrees(spark, name):
    df = catalogue.QUERIES[name](spark, LARGER)
    r = parity.connect(LARGER).execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in r.description]
    return exact(df.columns, [tuple(x) for x in df.collect()]) == exact(columns, r.fetchall())


@pytest.mark.parametrize("x", [0.0646875, -0.0646875, -0.0640625, 0.5, 0.1234565, -0.1234565, 1e-7, 123456.7890125, None, float("inf")])
def test_halves_fall_as_in_sql(spark, x):
    import duckdb

    got = spark.createDataFrame([(x,)], "x double").select(catalogue.nearest("x", 6)).first()[0]
    assert got == duckdb.execute("SELECT round(cast(? AS double), 6)", [x]).fetchone()[0]


def test_bins_by_position_to_the_last_digit(spark):
    assert agrees(spark, "bins_by_position")


def test_link_flips_to_the_last_digit(spark):
    assert agrees(spark, "link_flips")
