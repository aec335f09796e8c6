"""The operators' queries against their SQL."""

import duckdb
import pytest

from threadloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    sf = "/root/testdata/sf0.001"
    got = QUERIES[name](spark, sf).toPandas()
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = connection.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = sorted(got.columns)
    assert got[key].sort_values(key).values.tolist() == want[key].sort_values(key).values.tolist()
