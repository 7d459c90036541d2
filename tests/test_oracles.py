"""Every core query with SQL against DuckDB, on the smallest tables."""

import glob
import os
from datetime import datetime
from decimal import Decimal

import duckdb
import pytest

from memlake.queries import all_queries, all_sql

SQL = all_sql()


def cell(v):
    if v is None:
        return "null"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(cell, v)) + "]"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, int, Decimal)):
        return "nan" if v != v else repr(round(float(v), 6) + 0.0)
    return str(v.replace(tzinfo=None)) if isinstance(v, datetime) else str(v)


def rows(names, values):
    """Sorted rows, in which NaN and null are told apart."""
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted("|".join(cell(r[k]) for k in order) for r in values)


def of_spark(df):
    got = df.toArrow()
    return got.column_names, list(zip(*[c.to_pylist() for c in got.columns])) if got.num_columns else []


def of_duck(con, sql):
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, duck, name):
    got, want = of_spark(all_queries()[name](spark, sf_dir)), of_duck(duck, SQL[name])
    assert sorted(got[0]) == sorted(want[0])
    assert rows(*got) == rows(*want)


def test_null_is_not_nan():
    assert rows(["a"], [(None,)]) != rows(["a"], [(float("nan"),)])


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert all_queries()[name](spark, sf_dir).count() >= 0
