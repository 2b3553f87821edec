import duckdb
import pytest

from keelson.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_and_sql_agree(spark, name):
    con = duckdb.connect()
    for table in ("conversations", "pages", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cursor = con.execute(ORACLE_SQL[name])
    columns = sorted(d[0] for d in cursor.description)
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    want = sorted(tuple(str(r[i]) for i in at) for r in cursor.fetchall())
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    assert sorted(tuple(map(str, r)) for r in df.select(*columns).collect()) == want
