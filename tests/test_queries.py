"""Every registered query of the measurement operators against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from tierstats.plans import catalogue, tails
from tierstats.sources.fixtures import with_views

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cell(x):
    if x is None or x != x:
        return None
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return bool(x)
    if isinstance(x, (int, float)) or hasattr(x, "item"):
        x = float(x)
        return round(x, 7) + 0.0 if math.isfinite(x) else x
    return str(x)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    sql = catalogue.oracle_sql().get(name)
    if sql:
        want = duck.execute(sql)
        columns = [d[0] for d in want.description]
        assert table(got.columns, rows) == table(columns, want.fetchall())


def test_entry(spark, duck):
    """The flagship comparison, by region, with its p and both q."""
    tests = tails.mann_whitney("(SELECT grp, segment, state AS s, round(v, 6) AS v FROM feat)", "grp, segment")
    both = tails.with_q(tails.with_q(tests, "grp", "segment"), "", "grp, segment", "q_global")
    want = duck.execute(with_views(f"SELECT grp, segment, n1, n2, u, delta, median_delta, p, q, q_global, tier, q < 0.05 AS significant FROM {both}"))
    got = catalogue.entry(spark, SF)
    rows = [tuple(r) for r in got.collect()]
    assert rows and table(got.columns, rows) == table([d[0] for d in want.description], want.fetchall())
