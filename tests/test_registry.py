"""Every registered query runs, and gives the rows of its SQL twin where it has one."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from corpuslens.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = registry.oracle_sql()


def plain(v):
    """A value as both engines would show it: numbers as floats, not-a-number as text, the rest as text."""
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, (int, float, Decimal)):
        return "nan" if math.isnan(v) else float(v)
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    found = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    if name in ORACLE:
        r = duck.execute(ORACLE[name])
        at = {d[0]: i for i, d in enumerate(r.description)}
        assert sorted(at) == columns
        assert found == sorted((tuple(plain(x[at[c]]) for c in columns) for x in r.fetchall()), key=repr)


def test_every_oracle_has_its_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 80


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["source", "section", "grp", "field", "value"] and df.count() > 0
