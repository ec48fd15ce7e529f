"""Every query of the engine against its DuckDB SQL, on the smallest tables."""

import math

import pandas as pd
import pytest

from gridlight import plans

QUERIES, ORACLES = plans.queries(), plans.oracle_sql()


def plain(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return "null"
        if hasattr(v, "tolist"):
            v = v.tolist()
        return repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, data):
    found = QUERIES[name](spark, data).toPandas()
    if name not in ORACLES:
        assert len(found)
        return
    want = duck.sql(ORACLES[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    assert plain(found) == plain(want)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
