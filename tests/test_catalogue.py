"""Every query with an oracle against DuckDB on the smallest tables, value by value; the others must give rows."""

import decimal
import math

import duckdb
import pytest

from textloom import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
MAY_BE_EMPTY = {"near_dup_windows", "theta_join"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    def key(v):
        if isinstance(v, decimal.Decimal):
            v = float(v)
        if v is None:
            return (0, "")
        if isinstance(v, bool):
            return (1, str(v))
        if isinstance(v, (int, float)):
            return (2, str(int(v)) if math.isfinite(v) and v == int(v) else repr(v))
        return (3, str(v))

    return sorted(tuple(key(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*(f"`{c}`" for c in cols)).collect()]
    if name not in plans.ORACLE_SQL:
        assert got or name in MAY_BE_EMPTY
        return
    rel = con.sql(plans.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    exp = rel.select(*(duckdb.ColumnExpression(c) for c in cols)).fetchall()
    assert plain(got) == plain(exp)
