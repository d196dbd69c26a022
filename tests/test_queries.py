"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os
from collections import Counter

import pytest

import __spark_entry__ as entry_module

duckdb = pytest.importorskip("duckdb")
NAMES = sorted(set(entry_module.queries()) - {k for k in entry_module.queries() if k.startswith(("p2_", "p3_", "p5_", "p7_", "p8_", "p9_", "p10_"))})


def column(df, got, c):
    """Values of one column, each as often as it stands there."""
    k = sorted(df.columns).index(c)
    return [r[k] for r, n in got.items() for _ in range(n)]


def count(db, sql):
    return db.execute(sql).fetchone()[0]


def _scores(df, got, path, db):
    ids, s = column(df, got, "node_id"), column(df, got, "score")
    return len(ids) == len(set(ids)) > 0 and all(0 <= x <= 1 for x in s) and len(set(s)) > 1


def _intervals(df, got, path, db):
    lo, hi = column(df, got, "lower"), column(df, got, "upper")
    return len(lo) > 0 and all(a is None or a <= b for a, b in zip(lo, hi))


def _same_as_small(name):
    """The whole-size query has all columns of the one under SQL, and rows."""

    def check_(df, got, path, db):
        return sum(got.values()) > 0 and set(df.columns) >= set(entry_module.queries()[name](df.sparkSession, path).columns)

    return check_


#: what a query without SQL is checked for
NO_SQL = {
    "p6_origins": lambda df, got, path, db: sum(column(df, got, "n_with_value")) >= entry_module.queries()["p6_found"](df.sparkSession, path).count() and sum(column(df, got, "n")) <= count(db, "select count(*) from (select distinct * from activities)") and all(a >= b for a, b in zip(column(df, got, "n"), column(df, got, "n_with_value"))),
    "rf_score": _scores,
    "lr_score": _scores,
    "bootstrap_ci_full": _intervals,
    "baseline_compare_full": _intervals,
    "delta_auroc_test_full": _intervals,
    **{f"{k}_full": _same_as_small(k) for k in ("hub_flag", "cross_corpus_matrix", "cross_corpus_pivot", "horizon_curve", "path_atlas", "path_atlas_counts", "hub_partition")},
}


@pytest.fixture(scope="module")
def db(smallest):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(smallest):
        c.execute(f"create view {f.split('.')[0]} as select * from '{smallest}/{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, list):
        return tuple(v)
    return v


def check(name, spark, path, db, no_sql=None):
    df = entry_module.queries()[name](spark, path)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        checks = NO_SQL if no_sql is None else no_sql
        assert name in checks and checks[name](df, got, path, db), name
        return
    cur = db.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = Counter(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, smallest, db):
    check(name, spark, smallest, db)


def test_entry(spark, smallest):
    assert entry_module.entry(spark).count() > 0
