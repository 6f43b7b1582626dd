"""Every registered query against its DuckDB oracle (sf0.001).

The driver runs the same comparison at sf0.01; this keeps it green locally.
"""

import pytest

import __spark_entry__ as E
from ordermart.plans import registry
from ordermart.plans.check import _digest, _family, duck_connection

SF = "/root/testdata/sf0.001"
NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF)


def test_every_query_has_an_oracle():
    assert set(registry.oracle_sql()) == set(registry.queries())
    assert set(registry.queries()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 1
    assert df.columns == ["total_orders", "delayed_orders", "delay_rate_pct", "avg_delay_days_all",
                          "avg_delay_days_delayed"]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    rel = con.sql(E.oracle_sql()[name])
    orows = rel.fetchall()
    assert len(rows) == len(orows)
    assert sorted((c, _family(t)) for c, t in df.dtypes) == sorted(
        (c, _family(str(t))) for c, t in zip(rel.columns, rel.types)
    )
    assert _digest(df.columns, rows) == _digest(rel.columns, orows)
