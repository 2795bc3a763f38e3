"""Every registered query against its independent DuckDB SQL (row count, columns, values)."""

import os

import pytest

from tests.oracle_check import compare, duck

SF = os.environ.get("AUGSIGHT_TEST_SF", "/root/testdata/sf0.01")


def _names():
    from augsight.plans import oracle
    return sorted(oracle.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", _names())
def test_matches_oracle(spark, con, name):
    ok, rows, _, detail = compare(spark, con, name, SF)
    assert ok, detail


def test_every_query_has_oracle_or_is_rows_only():
    import __spark_entry__ as e
    from augsight.plans import catalog, oracle
    assert set(catalog.queries()) - set(oracle.oracle_sql()) == {"svm_report", "svm_cv"}
    assert set(catalog.queries()) <= set(e.queries()) and set(oracle.oracle_sql()) <= set(e.oracle_sql())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert df.columns == ["id", "title", "text", "event_type", "date", "source_doc_id"]
