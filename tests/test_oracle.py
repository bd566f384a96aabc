"""Every query with SQL gives the same rows as DuckDB; the others run and keep their columns."""

from pathlib import Path

import duckdb
import pytest

from textloom import registry
from tools.compare import rows_of

registry.load()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for p in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    cursor = con.execute(registry.ORACLE[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.collect(), df.columns) == rows_of(cursor.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_runs(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert df.columns
    df.write.format("noop").mode("overwrite").save()
