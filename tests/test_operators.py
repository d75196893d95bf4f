"""Missing values, ties, grains and vocabularies on literal rows."""

import pytest
from pyspark.sql import functions as F

from tierstats.operators import aggregate as A
from tierstats.operators import classify as C
from tierstats.operators import contracts as Q
from tierstats.operators import joins as J
from tierstats.operators import stats as S
from tierstats.operators import windows as W
from tierstats.sources import tables as T


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_record_choice_ignores_the_value(spark):
    d = spark.createDataFrame([(["B", "", "A"], [0.5, 0.5, 0.5], [9.0, 1.0, 5.0]), (["A", "B"], [0.0, 0.0], [1.0, 2.0]), (["B", "A"], [0.7, 0.7], [float("nan"), 2.0])], "l array<string>, o array<double>, v array<double>")
    got = [r[0] for r in d.select(A.pick_from_arrays(F.col("l"), F.col("o"), F.col("v"))["val"]).collect()]
    assert got == [1.0, None, 2.0]


def test_zscore_keeps_missing_rows(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", 5.0), ("c", 2.0), ("c", 2.0)], "i string, v double")
    got = {(r.i, r.v): (r.z, r.row_status) for r in A.zscore_within(d, "i", "v").collect()}
    assert got[("a", 1.0)] == (-1.0, "NORMALIZED") and got[("a", None)] == (None, "VALUE_MISSING")
    assert got[("b", 5.0)] == (None, "NOT_NORMALIZABLE_FEW_VALUES") and got[("c", 2.0)] == (None, "NOT_NORMALIZABLE_CONSTANT")


def test_statuses_and_flags(spark):
    d = spark.createDataFrame([([], None), ([1.0], 0.5), ([1.0, 2.0], 1.0), (None, 0.9)], "a array<double>, x double")
    got = rows(d.select(C.range_status(F.col("a"), 1, 2), C.all_le_status(F.col("a"), 1.5), *C.threshold_flags(F.col("x"), [0.9])))
    assert got == [("MISSING", "MISSING", None), ("PASS", "PASS_ALL", False), ("MULTI_VALUE_REVIEW", "MIXED", True), ("MISSING", "MISSING", True)]


def test_interval_union_joins_adjacent(spark):
    d = spark.createDataFrame([("k", 1, 5), ("k", 6, 8), ("k", 10, 12), ("k", 2, 3)], "k string, b int, e int")
    assert rows(W.merge_intervals(d, ["k"], "b", "e"), "start") == [("k", 1, 8), ("k", 10, 12)]


def test_gaps_merge_only_within_a_state(spark):
    r = spark.createDataFrame([("u", "SHEET", 1, 3), ("u", "SHEET", 7, 9), ("u", "HELIX", 11, 12), ("u", "SHEET", 14, 15)], "u string, s string, start int, end int")
    assert [(x.s, x.start, x.end) for x in W.merge_gaps(r, ["u"], "s", "SHEET").orderBy("start").collect()] == [("SHEET", 1, 9), ("HELIX", 11, 12), ("SHEET", 14, 15)]


def test_coordinate_maps_reject_conflicts(spark):
    r = spark.createDataFrame([("ok", 1, 3, 11, 13), ("len", 1, 3, 11, 12), ("two", 1, 2, 5, 6), ("two", 2, 3, 9, 10)], "k string, qb int, qe int, tb int, te int")
    assert rows(J.coordinate_map(r, "k"), "q") == [("ok", 1, 11), ("ok", 2, 12), ("ok", 3, 13)]


def test_fdr_leaves_null_p_out(spark):
    d = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "id int, p double")
    got = {r.id: r.q for r in W.bh_fdr(d, "p", [], ["id"]).collect()}
    assert got[4] is None and got[1] == pytest.approx(0.03) and got[2] == pytest.approx(0.04) and got[3] == pytest.approx(0.04)


def test_rank_tests_by_hand(spark):
    d = spark.createDataFrame([("t", "HOLO", float(x)) for x in (4, 5, 6)] + [("t", "APO", float(x)) for x in (1, 2, 3)], "t string, s string, v double")
    r = S.mann_whitney(d, ["t"], "s", "v").first()
    assert (r.u, r.delta, r.tier) == (9.0, 1.0, "EXPLORATORY") and r.p == pytest.approx(0.1)
    w = S.wilcoxon_one_sample(spark.createDataFrame([("t", float(x)) for x in (1, 2, 3, 4, 5)] + [("few", 1.0)], "t string, v double"), ["t"], "v")
    got = {x.t: (x.p, x.status, x.rank_biserial) for x in w.collect()}
    assert got["t"] == (0.0625, "TESTED", 1.0) and got["few"] == (None, "INSUFFICIENT_N", 1.0)


def test_kruskal_untestable_stays(spark):
    d = spark.createDataFrame([("a", "g", float(i)) for i in range(5)], "t string, g string, v double")
    assert [(r.t, r.h, r.status) for r in S.kruskal(d, ["t"], "g", "v").collect()] == [("a", None, "NOT_TESTABLE")]


def test_contracts_raise(spark):
    d = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="repeated key"):
        Q.grain_check(d, ["k"]).collect()
    with pytest.raises(Exception, match="outside the vocabulary"):
        Q.vocabulary_check(d, "v", ["a"]).collect()
    with pytest.raises(ValueError, match="missing columns"):
        Q.require_columns(d, ["x"])
    with pytest.raises(Exception, match="no override"):
        C.override_lookup(d, spark.createDataFrame([(2, "c")], "k int, c string"), "k", F.lit("d"), F.lit(True), "c").collect()


def test_fingerprint_ignores_order_and_partitions(spark):
    d = spark.range(1000).withColumn("v", F.col("id") % 7)
    assert rows(Q.fingerprint_table(d, ["id", "v"])) == rows(Q.fingerprint_table(d.orderBy(F.desc("id")).repartition(7), ["id", "v"]))


def test_csv_blanks(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,v\n1E10,\n007,z\n")
    schema = "id string, v string"
    assert rows(T.scan_csv(spark, str(tmp_path / "x.csv"), schema), "id") == [("007", "z"), ("1E10", None)]
    assert rows(T.scan_csv(spark, str(tmp_path / "x.csv"), schema, blank_as_null=False), "id") == [("007", "z"), ("1E10", "")]
    T.write_table(spark.range(3).toDF("id"), str(tmp_path / "out"), "csv")
    assert T.scan_csv(spark, str(tmp_path / "out"), "id long").count() == 3


def test_bootstrap_does_not_depend_on_partitions(spark):
    d = spark.createDataFrame([("t", i, float(i * i % 17)) for i in range(20)], "t string, i int, v double")
    assert rows(S.bootstrap_ci(d, ["t"], "v", 200)) == rows(S.bootstrap_ci(d.repartition(7), ["t"], "v", 200))


def test_nearest_within_makes_no_row_a_position(spark):
    """By brute force, with null keys, ties and sites at a row's own place; a wide reach makes three rows of a site."""
    import random

    rnd = random.Random(5)
    rows = [(rnd.choice([1, 2, None]), rnd.choice([*range(-60, 60), None]), i) for i in range(120)]
    sites = [(rnd.choice([1, 2, None]), rnd.choice([*range(-90, 90), None])) for _ in range(25)]
    df, s = spark.createDataFrame(rows, "k int, p long, i int"), spark.createDataFrame(sites, "k int, s long")
    from tierstats.operators import joins

    for w in (0, 3, 11):
        got = {r["i"]: (r["nearest"], r["distance"]) for r in joins.nearest_within(df, s, ["k"], "p", "s", w).collect()}
        want = {}
        for k, p, i in rows:
            near = [(abs(x - p), x) for g, x in sites if None not in (k, p, x) and g == k and abs(x - p) <= w]
            want[i] = min(near)[::-1] if near else (None, None)
        assert got == want
    plan = joins.nearest_within(df, s, ["k"], "p", "s", 10_000_000)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan
