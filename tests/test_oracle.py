"""Layer 1: every query with a SQL twin equals DuckDB on the driver tables."""

import pytest

from rulesift.plans import catalog
from rulesift.plans.oracle_check import compare

from conftest import SF01

catalog.load_all()


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_duckdb(spark, name):
    r = compare(spark, name, catalog.QUERIES[name], catalog.ORACLE[name], SF01)
    assert r["ok"], r["why"]


def test_every_query_builds(spark):
    # Queries without a SQL twin must at least plan and run at the smoke scale.
    for name, q in sorted(catalog.QUERIES.items()):
        if name in catalog.ORACLE:
            continue
        df = q(spark, "/root/testdata/sf0.001")
        assert df.count() >= 0, name


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
