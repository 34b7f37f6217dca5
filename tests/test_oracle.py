"""Every registered query against its DuckDB oracle on the smallest data."""

import pytest

from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.01"  # the oracle SQL carries the sf0.01 thresholds


def _names():
    from exposa.plans.catalog import ORACLE
    return sorted(ORACLE)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, name):
    from exposa.plans.catalog import ORACLE, QUERIES
    ok, info = compare(spark, con, name, QUERIES[name], ORACLE[name], SF)
    assert ok, info


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())


def _rows_only():
    from exposa.plans.catalog import ORACLE, QUERIES
    return sorted(n for n in QUERIES if n not in ORACLE)


@pytest.mark.parametrize("name", _rows_only())
def test_model_query_runs(spark, name):
    """Queries without an oracle (iterative fits) run and return rows on the
    smallest data; their numbers are checked in test_models.py."""
    from exposa.plans.catalog import QUERIES
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
