from pathlib import Path

import duckdb
import pytest

from textloom.llm.queries import ORACLE, QUERIES
from tools.compare import rows_of

COLUMNS = {
    "p1_found": ["queryId", "documentId", "level"], "p2_found": ["queryid", "documentid"], "p4_found": ["item_table", "item_key"], "p5_found": ["node_1", "node_2"],
    "p6_found": ["id_1", "id_2"], "p7_found": ["name_1", "name_2"], "p8_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "start_char", "end_char"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_found_columns_and_no_duplicates(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns == COLUMNS[name]
    rows = df.collect()
    assert rows and len(rows) == len(set(rows))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for p in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    df = QUERIES[name](spark, sf)
    cursor = con.execute(ORACLE[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.collect(), df.columns) == rows_of(cursor.fetchall(), columns)
