import os

import duckdb
import pytest

from strandkit import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_sql(spark, con, name):
    a, b = core.QUERIES[name](spark, SF).toPandas(), con.execute(core.SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    assert sorted(map(tuple, a[cols].astype(str).values.tolist())) == sorted(map(tuple, b[cols].astype(str).values.tolist()))


def test_zip64_records_of_large_keys(spark, tmp_path):
    """Keys of larger tables, whose sizes and offsets pass 2^53."""
    path = str(tmp_path / "orders.parquet")
    duckdb.sql(f"copy (select unnest([0, 1, 2097151, 2097152, 8999999, 2147483647])::bigint as o_orderkey) to '{path}' (format parquet)")
    c = duckdb.connect()
    c.execute(f"create view orders as select * from read_parquet('{path}')")
    rows = core.zip64_records(spark, str(tmp_path))
    want = c.execute(core.SQL["zip64_records"]).df()[rows.columns].values.tolist()
    assert sorted(map(list, rows.collect())) == sorted(want) and max(r[1] for r in want) == 2147483647 << 32


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_crc_of_whole_documents(spark):
    import zlib

    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r["doc_id"]: r["crc"] for r in core.crc32_documents(spark, SF).collect()} == {k: zlib.crc32(v.encode()) for k, v in text.items()}


def test_entry_point():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
