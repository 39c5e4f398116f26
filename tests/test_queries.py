"""Every registered query of the engine against its SQL."""

import math
from pathlib import Path

import duckdb
import pytest

from quire import catalog_of_queries as own

SF = Path("/root/testdata/sf0.001")


def rows(frame):
    names = sorted(frame.columns)
    values = [tuple(round(v, 9) if isinstance(v, float) and not math.isnan(v) else str(v) for v in r) for r in frame[names].itertuples(index=False)]
    return names, sorted(values, key=repr)


@pytest.mark.parametrize("name", list(own.queries()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got = own.queries()[name](spark, str(SF)).toPandas()
    assert rows(got) == rows(con.execute(own.oracle_sql()[name]).df())
