"""The registered queries: their SQL in DuckDB, where there is one, and their columns."""

import duckdb
import pytest

from rillflow.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    df = QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: tuple(str(v) for v in r)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=key) == sorted(cursor.fetchall(), key=key)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_without_sql(spark, name):
    df = QUERIES[name](spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert df.select("doc_id").distinct().count() == n
