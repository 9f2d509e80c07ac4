"""Every registered query of the cube engine against its SQL in DuckDB, as multisets of rows."""

import datetime
import decimal
import math

import duckdb
import pytest

from chronogrid import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, "" if x is None else str(type(x)), 0 if x is None else round(x, 3) if isinstance(x, float) else x) for x in r))


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_sql(spark, duck, sf_dir, name):
    df = Q.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    mine = [tuple(plain(x) for x in r) for r in df.select(*columns).collect()]
    found = duck.execute(Q.oracle_sql()[name])
    at = [c[0] for c in found.description]
    assert sorted(at) == columns
    theirs = [tuple(plain(r[at.index(c)]) for c in columns) for r in found.fetchall()]
    assert len(mine) == len(theirs)
    for a, b in zip(ordered(mine), ordered(theirs), strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or isinstance(x, float) and isinstance(y, (float, int)) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9), (name, a, b)


def test_every_query_without_sql_runs(spark, sf_dir):
    for name in sorted(set(Q.queries()) - set(Q.oracle_sql())):
        assert Q.queries()[name](spark, sf_dir).count() >= 0, name


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["px", "period", "value"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
