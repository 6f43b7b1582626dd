"""The registered queries that SQL can express, on the small tables."""

import pytest

from ordermart.llm import queries
from ordermart.plans.check import _digest, _family, duck_connection

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_oracle(spark, name):
    df = queries.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    rel = duck_connection(SF).sql(queries.ORACLES[name])
    assert sorted((c, _family(t)) for c, t in df.dtypes) == sorted((c, _family(str(t))) for c, t in zip(rel.columns, rel.types, strict=True))
    assert _digest(df.columns, rows) == _digest(rel.columns, rel.fetchall())


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
