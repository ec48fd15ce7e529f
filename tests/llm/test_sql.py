"""The queries that SQL expresses, against DuckDB."""

import pytest

from gridlight.llm import registry

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(name, spark, duck, data):
    found, want = registry.queries()[name](spark, data).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    plain = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).to_numpy()))
    assert plain(found) == plain(want)
