"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tessera.plans import registry


def rows(frame: pd.DataFrame) -> list[str]:
    def norm(v):
        if isinstance(v, float) and v == int(v):
            return int(v)
        return list(v) if hasattr(v, "tolist") and not isinstance(v, (int, float, str)) and hasattr(v, "__len__") else v

    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted(str([norm(v) for v in r]) for r in frame.values.tolist())


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_run(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
