"""Exact dedup of a table with repeated rows against the query's SQL."""

import duckdb

import __spark_entry__ as entry


def test_repeated_rows_come_back_one_by_one(spark, tmp_path):
    rows = "(1, 'same'), (1, 'same'), (2, 'same'), (3, 'alone'), (4, 'twice'), (4, 'twice')"
    con = duckdb.connect()
    con.execute(f"CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text FROM (VALUES {rows}) AS t(doc_id, text)")
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    want = con.execute(entry.oracle_sql()["op6_exact_dedup"]).fetchall()
    got = [tuple(r) for r in entry.queries()["op6_exact_dedup"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(got) == 6
