"""Every registered query against its check SQL on DuckDB, and the contract of the entry file."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
# fit many models; run at the next scale only
SLOW = {n for n in QUERIES if n.startswith("ml") and "folds" not in n} | {"snk6_saved_model"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 2e-6 * max(1.0, abs(a))
    if hasattr(a, "isoformat") and hasattr(b, "isoformat"):
        return str(a)[:19] == str(b)[:19]
    return a == b


def key(row):
    return [(v is None, round(v, 3) if isinstance(v, float) else v) if not isinstance(v, (list, dict)) else (False, str(v)) for v in row]


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    mine = [tuple(r[c] for c in columns) for r in df.collect()]
    cursor = duck.execute(SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    where = [names.index(c) for c in columns]
    theirs = [tuple(r[i] for i in where) for r in cursor.fetchall()]
    assert len(mine) == len(theirs)
    exact = [i for i, c in enumerate(columns) if not mine or not any(isinstance(r[i], float) for r in mine)]
    order = lambda r: [(r[i] is None, str(r[i])) for i in exact] + key(r)
    for a, b in zip(sorted(mine, key=order), sorted(theirs, key=order)):
        assert all(same(x, y) for x, y in zip(a, b)), (columns, a, b)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL and n not in SLOW])
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).columns


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "total_score" in df.columns


def test_check_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


def test_registered_queries_run_with_the_default_parameters():
    import inspect
    from barspark.operators import factors
    from barspark.plans import research_queries as plans

    assert plans.HORIZONS == inspect.signature(factors.with_forward).parameters["horizons"].default
    source = inspect.getsource(plans)
    for cut in ("ml.folds(rows, ", "classify, trees=", '"ridge", 2)', "daily(s, d)))), 200)"):
        assert cut not in source
