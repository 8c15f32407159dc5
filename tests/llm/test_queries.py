"""Every registered query of the subpackage runs on a table, and gives the rows of its SQL twin where it has one."""

import os

import duckdb
import pytest

import corpus_pipeline
from corpuslens.llm import queries
from tests.test_registry import TABLES, plain

ORACLE = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    columns = sorted(df.columns)
    found = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    assert found
    if name in ORACLE:
        con = duckdb.connect()
        for t in TABLES:
            path = f"{sf}/{t}.parquet"
            con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
        r = con.execute(ORACLE[name])
        at = {d[0]: i for i, d in enumerate(r.description)}
        assert set(at) <= set(columns)
        some = sorted(at)
        mine = sorted((tuple(plain(x[c]) for c in some) for x in df.select(*some).collect()), key=repr)
        assert mine == sorted((tuple(plain(x[at[c]]) for c in some) for x in r.fetchall()), key=repr)


def test_pipeline_leaves_one_copy_at_most(spark, sf, monkeypatch):
    """The tables between stages go when they are read no more."""
    kept = []
    monkeypatch.setattr(corpus_pipeline, "discard", lambda *t: kept.append(t))
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert len(kept) == len(corpus_pipeline.STAGES) - 1
