"""Every registered query with an SQL oracle must agree with DuckDB (sf0.001)."""

import math
import re

import duckdb
import pytest

from .conftest import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

# queries of an optional subpackage, which has tests of its own
OWN_TESTS = re.compile(r"op\d+_|pipeline$")


def _canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else f"{round(v, 6):.6f}"
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_canon(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET max_temp_directory_size='4GB'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _names():
    import __spark_entry__ as E

    return sorted(n for n in E.oracle_sql() if not OWN_TESTS.match(n))


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as E

    sdf = E.queries()[name](spark, SF_SMALL)
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert _rows(sdf.columns, [tuple(r) for r in sdf.collect()]) == _rows(dcols, res.fetchall())


def test_entry_runs(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() >= 0
    assert set(df.columns) >= {"src_col", "tgt_col", "score"}


def _all_names():
    import __spark_entry__ as E

    return sorted(n for n in E.queries() if not OWN_TESTS.match(n))


@pytest.mark.parametrize("name", _all_names())
def test_plan_has_no_cartesian_join(spark, name):
    """No registered query may plan a cartesian product or a nested-loop join."""
    import __spark_entry__ as E

    df = E.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
