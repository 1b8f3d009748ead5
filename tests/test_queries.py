"""Every registered query against its SQL on the smallest tables."""

import datetime
import glob
import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry_module

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test tables")
TEXT = re.compile(r"op\d+_|pipeline$")  # these have tests of their own
QUERIES = {n: f for n, f in entry_module.queries().items() if not TEXT.match(n)}
SQL = {n: s for n, s in entry_module.oracle_sql().items() if not TEXT.match(n)}


@pytest.fixture(scope="module")
def duck():
    """One connection per table folder."""
    out = {}
    for sf in (SMALL, LARGER):
        out[sf] = duckdb.connect()
        for f in glob.glob(f"{sf}/*.parquet"):
            out[sf].execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return out


def folder(name):
    """SQL has no pseudo-inverse, so queries that invert a covariance need tables
    large enough for it to be regular. test_scoring_model.py covers the singular case."""
    return LARGER if "inverses AS" in SQL.get(name, "") else SMALL


def text(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float):
        return repr(v + 0.0)
    return v.isoformat() if isinstance(v, datetime.date) else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(text(r[k]) for k in order) for r in rows)


def test_names():
    assert set(SQL) <= set(QUERIES)
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    sf = folder(name)
    df = QUERIES[name](spark, sf)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if name in SQL:
        cur = duck[sf].execute(SQL[name])
        assert got == table([d[0] for d in cur.description], cur.fetchall())
    else:
        assert got[1]


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
