"""Every registered query of the core runs, and equals its SQL form where it has one."""

import math

import duckdb
import pytest
from corpuslens.plans.queries import REGISTRY

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, duck, sf_dir, name):
    fn, sql = REGISTRY[name]
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    assert df.columns
    if sql:
        r = duck.execute(sql)
        columns = [d[0] for d in r.description]
        assert sorted(columns) == sorted(df.columns)
        assert canonical(rows, df.columns) == canonical(r.fetchall(), columns)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
