"""Every query that SQL can express against that SQL; the others for rows."""

import duckdb
import pandas as pd
import pytest

from tabloom import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def flat(df):
    df = df[sorted(df.columns)]
    return df.sort_values([*df.columns]).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck(sf_dir):
    from pathlib import Path

    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    found = QUERIES[name](spark, sf_dir).toPandas()
    if name not in SQL:
        assert len(found)
        return
    expected = duck.execute(SQL[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    pd.testing.assert_frame_equal(flat(found), flat(expected), check_dtype=False, rtol=1e-9, atol=1e-9)
