"""The driver contract: every core query against its SQL."""

import pytest

import __spark_entry__ as driver
from lodestar.plans.oracle import oracle_sql
from lodestar.plans.queries import queries
from tests.compare import database, differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_and_sql_agree(spark, name):
    assert differences(queries()[name](spark, SF), database(SF), oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_sql(spark, name):
    assert queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
