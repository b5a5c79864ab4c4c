"""Every query of the catalogue against its SQL."""

import duckdb
import pandas as pd
import pytest

from bagframe.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    ours, theirs = ordered(QUERIES[name](spark, SF).toPandas()), ordered(duck.execute(ORACLE_SQL[name]).df())
    assert len(ours) > 0
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False, atol=2e-6)
