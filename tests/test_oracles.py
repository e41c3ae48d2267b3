"""Each registered query of the graph engine against its SQL in DuckDB."""

import duckdb
import pytest

from loomgraph import queries

TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_its_sql(spark, duck, small, name):
    df = queries.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    want = duck.sql(queries.SQL[name])
    assert sorted(want.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    rows = sorted(map(tuple, df.select(*columns).collect()), key=repr)
    assert rows == sorted(duck.sql(f"SELECT {quoted} FROM want").fetchall(), key=repr)
