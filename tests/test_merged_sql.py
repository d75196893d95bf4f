"""The SQL of merged intervals names no order that equal intervals would leave open."""

import duckdb

from tierstats.plans import catalogue


def test_equal_intervals_are_one():
    c = duckdb.connect()
    # each interval many times
    c.execute("CREATE TABLE lineitem AS SELECT (i % 10)::BIGINT AS l_suppkey, (i % 10 * 30)::BIGINT AS l_partkey, 7.0::DOUBLE AS l_quantity FROM range(400000) r(i)")
    got = c.execute(catalogue.oracle_sql()["WN6_merge_intervals"]).fetchall()
    assert sorted(got) == [(k, k * 30 + 1, k * 30 + 7) for k in range(10)]
    assert "DISTINCT k, b, e" in catalogue.oracle_sql()["WN6_merge_intervals"]
