"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import math

import duckdb
import pytest

from sessionloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, con, name):
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert ours == sorted(tuple(plain(r[k]) for k in at) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_which_have_no_sql():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"fitted_recommend", "lambdarank_recommend", "als_top", "streamed_windows"}


def listed(rows, key):
    by = {}
    for r in rows:
        by.setdefault(tuple(r[k] for k in key) if isinstance(key, tuple) else r[key], []).append(r)
    return {k: sorted(v, key=lambda r: r.rank) for k, v in by.items()}


@pytest.mark.parametrize(("name", "key"), [("fitted_recommend", "session"), ("lambdarank_recommend", ("session", "type")), ("als_top", "user")])
def test_lists_of_fitted_models(spark, con, name, key):
    lists = listed(catalogue.queries()[name](spark, DATA).collect(), key)
    item = "item" if key == "user" else "aid"
    assert lists and all([r.rank for r in v] == list(range(1, len(v) + 1)) and len(v) <= 20 for v in lists.values())
    assert all(len({r[item] for r in v}) == len(v) and all(a.score >= b.score for a, b in zip(v, v[1:], strict=False)) for v in lists.values())
    if name == "als_top":  # what a user bought ranks high with the user's own factors
        bought = {}
        for u, i in con.execute("SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey").fetchall():
            bought.setdefault(u, set()).add(i)
        share = sum(len(bought[u] & {r.item for r in v}) for u, v in lists.items()) / sum(min(20, len(bought[u])) for u in lists)
        assert len(lists) == len(bought) and share > 0.3


def test_streamed_windows(spark, con):
    rows = {r.window_start.replace(tzinfo=None): r for r in catalogue.queries()["streamed_windows"](spark, DATA).collect()}
    sql = catalogue.oracle_sql()["streamed_hours"]
    assert len(rows) == con.execute(f"SELECT count(*) FROM ({sql})").fetchone()[0]
    assert sum(r.total_events for r in rows.values()) == con.execute(f"SELECT sum(total_events) FROM ({sql})").fetchone()[0]
    assert all(0 < r.unique_sessions <= 1.2 * r.total_events + 1 for r in rows.values())
