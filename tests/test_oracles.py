"""Every registered query against its SQL on the smallest benchmark tables."""

from pathlib import Path

import pytest

import __spark_entry__ as driver
from checks import compare, oracle, queries

FOLDER = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="benchmark tables are not here")


@pytest.fixture(scope="module")
def connection():
    return compare.connect(str(FOLDER))


def test_every_query_has_its_sql():
    assert set(queries.queries()) == set(oracle.oracle_sql())
    assert set(queries.queries()) <= set(driver.queries()) and set(oracle.oracle_sql()) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_its_sql(spark, connection, name):
    assert compare.difference(spark, connection, str(FOLDER), name) is None


def test_entry(spark):
    frame = driver.entry(spark)
    assert frame.columns == ["host_ip", "score", "fascia", "metriche_attive", "penalita_totale"]
    assert frame.count() > 0
