"""The registered queries on the driver's smallest tables: against their SQL, and against the contract's columns."""

import duckdb
import pytest

from corpusloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    found = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    heads = [x[0] for x in cur.description]
    assert heads == found.columns
    assert sorted(map(tuple, found.collect()), key=str) == sorted(cur.fetchall(), key=str)


def test_columns_of_the_contract(spark):
    found = QUERIES["op1_simhash"](spark, SF)
    rows = found.collect()
    assert found.columns[:3] == ["doc_id", "fingerprint", "component_id"] and all(len(r.fingerprint) == 16 and r.fingerprint == r.fingerprint.lower() for r in rows)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(rows) == n
    first = {"op7_personal_data": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], "op6_media": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]}
    for name, columns in first.items():
        assert QUERIES[name](spark, SF).columns[: len(columns)] == columns
