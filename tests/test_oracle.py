"""Every registered query against its DuckDB twin (sf0.001), and a rows check for the rest."""

import pytest

from conftest import SMALL
from lodestar.plans import catalog
import oracle_check as OC


@pytest.fixture(scope="module")
def con():
    return OC.duck(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    r = OC.compare(spark, con, name, SMALL)
    if name in catalog.ORACLE_SQL:
        assert r["cols_match"], r
        assert r["match"], r
    else:
        assert r["spark_rows"] > 0


def test_entry_contract():
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())
