"""Every query against the SQL that states its result, on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from mnemospark import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float | Decimal) and not isinstance(v, bool):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}")
    return tuple(plain(x) for x in v) if isinstance(v, list | tuple) else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, db, name):
    df = plans.QUERIES[name](spark, DATA)
    result = db.execute(plans.SQL[name])
    assert table(df.columns, df.collect()) == table([c[0] for c in result.description], result.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_without_sql_runs(spark, name):
    assert plans.QUERIES[name](spark, DATA).columns


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
