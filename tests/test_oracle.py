"""Every query with SQL agrees with DuckDB on the smallest tables; the entry point runs."""

import pytest
from compare import connect, differences

from flowlens.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, con, key):
    assert differences(QUERIES[key](spark, sf_dir), con, ORACLES[key]) == []


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_reports_every_class(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert rows[0].asDict().keys() == {"class", "precision", "recall", "f1", "support"}
    assert {"BENIGN", "avg / total"} <= {r["class"] for r in rows}
    assert set(e.queries()) >= set(QUERIES) and set(e.oracle_sql()) >= set(ORACLES)
    assert set(e.oracle_sql()) <= set(e.queries())
