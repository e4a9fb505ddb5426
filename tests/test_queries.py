"""Every registered query of the reference's own operators against its SQL, and what the entry promises."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from loomgrid import plans
from loomgrid.functions.paths import join_steps


def value(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, (list, tuple)):
        return str([value(y) for y in x])
    if isinstance(x, dict):
        return str(sorted((str(k), value(v)) for k, v in x.items()))
    try:
        x = float(x)
    except (TypeError, ValueError):
        return str(x)
    return "nan" if math.isnan(x) else f"{x:.6g}"


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_gives_what_its_sql_gives(spark, sf_dir, duck, name):
    df = plans.QUERIES[name](spark, sf_dir)
    cursor = duck.execute(plans.ORACLE[name])
    assert comparable(df.collect(), df.columns) == comparable(cursor.fetchall(), [c[0] for c in cursor.description])


def test_entry(spark):
    assert contract.entry(spark).columns and set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize(("steps", "path"), [(("a", "b", ".."), "a"), (("", ".."), ""), (("a", "..", "..", ".."), "../.."), (("a", "b", "", "r"), "/r"), (("a", "."), "a"), ((".",), ".")])
def test_step_joins(steps, path):
    assert join_steps(*steps) == path
