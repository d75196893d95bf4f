"""Views that a query asks for several times are worked out once, and medians of many small groups."""

import os

import pytest
from pyspark.sql import functions as F

from tierstats.operators import aggregate as A
from tierstats.sources import fixtures

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_a_view_is_written_once_a_query(spark):
    with fixtures.one_query():
        first, again = fixtures.unitseg(spark, SF), fixtures.unitseg(spark, SF)
        assert first.inputFiles() == again.inputFiles()
        other = again.select("unit", "segment", F.col("v").alias("w"))
        assert first.join(other, ["unit", "segment"]).where("v = w").count() == first.count()  # joins to itself
    with fixtures.one_query():
        assert fixtures.unitseg(spark, SF).inputFiles() != first.inputFiles()


def test_medians_are_those_of_spark(spark):
    rows = [(g % 7 if g % 11 else None, float(g * 37 % 101) if g % 5 else None) for g in range(300)] + [(9, None), (10, 1.5)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = A.medians(df, ["k"], "v", "m", F.count(F.lit(1)).alias("n"))
    assert sorted(map(str, got.collect())) == sorted(map(str, df.groupBy("k").agg(F.median("v").alias("m"), F.count(F.lit(1)).alias("n")).collect()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_records_of_an_entry_are_dealt_out_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = fixtures._prof(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("hashpartitioning(entry") == 1 and "hashpartitioning(instance" not in plan and "hashpartitioning(unit" not in plan
    keys = ["unit", "grp", "entry", "instance", "position", "state", "resolution"]
    old = A.zscore_within(A.pick_record(fixtures.rec(spark, SF), keys, "occupancy", "value", fixtures.TIES), "instance", "value")
    old = A.entry_position_profile(old, ["unit", "grp", "entry", "position", "state", "resolution"])
    seen = lambda df: sorted(map(str, df.select("unit", "grp", "entry", "position", "state", "resolution", F.round("z", 9).alias("z"), "n_instances").collect()))
    assert seen(fixtures._prof(spark, SF)) == seen(old)


def test_the_rows_of_a_complete_view_are_written_before_they_are_fitted(spark, monkeypatch):
    from tierstats.operators import matrix as M

    names, keep, rows = [], M.staged, [(i, f"S{f}", float((i * (f + 3) * 37) % 11)) for i in range(30) for f in range(3) if (i, f) != (4, 1)]
    monkeypatch.setattr(M, "staged", lambda d, name: names.append(name) or keep(d, name))
    out = M.complete_entry_view(spark.createDataFrame(rows, "id int, feature string, value double"), ["S0", "S1", "S2"])
    assert out.count() == 2 * 29 and names == ["complete-rows", "pca-rows"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_curated_scores_deal_records_to_their_entry_once(spark):
    """Wide records went by their seven keys, by instance, by entry and position, and by position."""
    import re

    from tierstats.operators import quantiles as Q
    from tierstats.plans import catalogue

    seen, keep = [], Q.staged
    Q.staged = lambda d, name: seen.append(d._jdf.queryExecution().toString()) or keep(d, name)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = catalogue.queries()["CL18_curated_site_scores"](spark, SF)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        Q.staged = keep
    plan = seen[0].split("== Physical Plan ==")[1]
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert [re.findall(r"[a-z_]+(?=#)", x) for x in dealt if "entry#" in x or "instance#" in x] == [["entry"]]
    assert got.count() == 25
