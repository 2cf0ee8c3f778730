"""Every query that has SQL gives the same rows as DuckDB does, at the smallest scale."""

import math
import os

import duckdb
import pytest

from spindrift.plans import call_queries, context_queries, finding_queries, graph_queries, line_queries, more_queries, program_queries, rule_queries, stage_queries  # noqa: F401
from spindrift.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x if x is None or isinstance(x, bool | int) else str(x)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    want = db.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"c1_scan_corpus"}))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
