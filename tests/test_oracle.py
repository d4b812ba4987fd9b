"""Every registered bar query against DuckDB on the smallest data."""

import pytest
from pyspark.sql import functions as F

from barloom.plans import oracle, queries, surface
from tests.oracle import DATA, connect, difference

SF = "sf0.001"
QUERIES, ORACLE = queries.QUERIES | surface.QUERIES, oracle.ORACLE | surface.ORACLE


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, f"{DATA}/{SF}").toPandas(), duck.sql(ORACLE[name]).df()) == ""


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_win_rates_round_halves_to_even(spark, duck):
    df = spark.createDataFrame([(25, 32), (17, 800), (1, 160), (3, 160), (2, 3)], "k int, n int")
    found = [r[0] for r in df.select(queries.four_digits(F.col("k") / F.col("n"))).collect()]
    sql = duck.sql(f"SELECT {oracle.FOUR_DIGITS.format('(k / n)')} AS x FROM (VALUES (25, 32), (17, 800), (1, 160), (3, 160), (2, 3)) t(k, n)").df().x.tolist()
    assert found == sql == ["0.7812", "0.0212", "0.0062", "0.0188", "0.6667"]
