"""Every registered query against its DuckDB oracle (same check as the
driver, at sf0.001 to keep the suite quick; the driver runs sf0.01)."""

import pytest

import __spark_entry__ as entry_mod
from vigilspark.plans.compare import compare, duck_connect

from .conftest import SF_SMALL

QUERIES = entry_mod.queries()
ORACLE = entry_mod.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name not in ORACLE:
        assert QUERIES[name](spark, SF_SMALL).count() > 0
        return
    assert compare(spark, con, name, QUERIES[name], ORACLE[name], SF_SMALL, verbose=True)


def test_entry(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert "final_text" in df.columns


def test_oracle_keys_are_queries():
    assert set(ORACLE) <= set(QUERIES)
