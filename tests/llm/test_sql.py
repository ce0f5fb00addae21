"""Queries of the operators with SQL give the rows that DuckDB gives on the same tables."""

import duckdb
import pytest

from postmill.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    theirs = sorted((dict(zip(names, r)) for r in found.fetchall()), key=lambda r: r["doc_id"])
    ours = sorted((r.asDict() for r in queries.QUERIES[name](spark, SF).collect()), key=lambda r: r["doc_id"])
    assert ours == theirs
