"""Every registered query against its SQL, on the smallest driver tables when they are present."""

import glob
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for r in data:
        out.append(tuple(float(r[i]) if isinstance(r[i], float) else r[i] for i in order))
    return sorted(out, key=lambda r: tuple(str(v) for v in r))


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    cur = duck.execute(sql)
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, cur.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_names_and_sql_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    numbered = {n for n in entry.queries() if n.startswith("op") and n[2:3].isdigit()}
    assert numbered == set(entry.LLM_QUERIES)
    assert set(entry.queries()) - set(entry.QUERIES) - numbered == set(entry.PIPELINE)
