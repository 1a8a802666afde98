"""Every query of the engine that SQL can express, held against DuckDB."""

import pytest

from quietline import catalog
from tests import oracle

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, con, name):
    assert oracle.compare(spark, con, catalog.queries()[name], catalog.oracle_sql()[name], SF_DIR) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
