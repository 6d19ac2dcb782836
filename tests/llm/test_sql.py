"""The SQL of this package's queries against the queries."""

import duckdb
import pandas as pd
import pytest

from tabloom.llm import queries

QUERIES, SQL = queries.queries(), queries.oracle_sql()


def flat(df):
    df = df[sorted(df.columns)]
    return df.sort_values([*df.columns]).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    found, expected = QUERIES[name](spark, sf_dir).toPandas(), con.execute(SQL[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    pd.testing.assert_frame_equal(flat(found), flat(expected), check_dtype=False)
