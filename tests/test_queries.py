"""Each registered query against its SQL, on the same Parquet files."""

import duckdb
import pandas as pd
import pytest

from threadloom.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime") or df[c].map(type).astype(str).str.contains("date").any():
            df[c] = pd.to_datetime(df[c]).astype("datetime64[us]").astype(str)
    key = lambda x: "" if pd.isna(x) else round(float(x), 5) if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)
    return sorted([tuple(key(x) for x in r) for r in df.itertuples(index=False)], key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
