"""Queries of the window, set and contract operators."""

from pyspark.sql import functions as F

from tierstats.operators import contracts as Q
from tierstats.operators import joins as J
from tierstats.operators import windows as W
from tierstats.sources.fixtures import feat, ivals, norm, obs, prof, rec, table, unitseg

from .registry import query

c = F.col


@query("WN1_select_representative", """WITH q AS (SELECT unit, entry, instance, count(value) AS usable, count(*) - count(value) AS missing FROM obs GROUP BY ALL),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY usable DESC, missing, instance) AS rn, count(*) OVER (PARTITION BY entry) AS n FROM q) WHERE rn = 1)
SELECT b.entry, b.instance, CASE WHEN n = 1 THEN 'ONLY_ONE' WHEN (SELECT count(*) FROM q WHERE q.entry = b.entry AND q.usable = b.usable) < n THEN 'usable'
  WHEN (SELECT count(*) FROM q WHERE q.entry = b.entry AND q.usable = b.usable AND q.missing = b.missing) < n THEN 'missing' ELSE 'instance' END AS decided_by FROM b""")
def wn1(s, d):
    q = obs(s, d).groupBy("unit", "entry", "instance").agg(F.count("value").alias("usable"), (F.count("*") - F.count("value")).alias("missing"))
    return W.select_representative(q, ["entry"], [("usable", True), ("missing", False), ("instance", False)]).select("entry", "instance", "decided_by")


@query("WN2_select_reference", """SELECT unit, entry FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY (state = 'HOLO') DESC, (resolution > 0) DESC, n DESC, entry) AS rn FROM (SELECT unit, entry, state, resolution, count(*) AS n FROM obs GROUP BY ALL)) WHERE rn = 1""")
def wn2(s, d):
    q = obs(s, d).groupBy("unit", "entry", "state", "resolution").agg(F.count("*").alias("n"))
    return W.select_reference(q, "unit", [c("state") == "HOLO", c("resolution") > 0], [c("n").desc_nulls_last(), c("entry")]).select("unit", "entry")


@query("WN3_top_n_candidates", """SELECT unit, entry, rank FROM (SELECT unit, entry, row_number() OVER (PARTITION BY unit ORDER BY n DESC, entry) AS rank FROM (SELECT unit, entry, count(*) AS n FROM obs GROUP BY ALL)) WHERE rank <= 10""")
def wn3(s, d):
    q = obs(s, d).groupBy("unit", "entry").agg(F.count("*").alias("n"))
    return W.top_n(q, ["unit"], [F.desc("n"), c("entry")], 10).select("unit", "entry", "rank")


_RUNS = """SELECT instance, st, min(position) AS "start", max(position) AS "end" FROM (SELECT instance, position, st, position - row_number() OVER (PARTITION BY instance, st ORDER BY position) AS i FROM (SELECT instance, position, CASE WHEN value > 40000 THEN 'HIGH' ELSE 'LOW' END AS st FROM obs)) GROUP BY instance, st, i"""


def _runs(s, d):
    return W.runs(obs(s, d).withColumn("st", F.when(c("value") > 40000, "HIGH").otherwise("LOW")), ["instance"], "position", "st")


@query("WN4_runs", f"""SELECT *, "end" - "start" + 1 AS length FROM ({_RUNS})""")
def wn4(s, d):
    return _runs(s, d)


@query("WN5_merge_gaps", f"""WITH r AS ({_RUNS}), g AS (SELECT *, sum(fresh) OVER (PARTITION BY instance ORDER BY "start") AS g FROM (SELECT *, CASE WHEN st = 'HIGH' AND lag(st) OVER w = 'HIGH' AND "start" - lag("end") OVER w - 1 <= 5 THEN 0 ELSE 1 END AS fresh FROM r WINDOW w AS (PARTITION BY instance ORDER BY "start")))
SELECT instance, min(st) AS st, min("start") AS "start", max("end") AS "end", count(*) AS n_merged FROM g GROUP BY instance, g""")
def wn5(s, d):
    return W.merge_gaps(_runs(s, d), ["instance"], "st", "HIGH", 5)


_MERGED = """SELECT k, min(b) AS "start", max(e) AS "end" FROM (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN b <= max(e) OVER (PARTITION BY k ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM (SELECT DISTINCT k, b, e FROM ivals))) GROUP BY k, g"""


@query("WN6_merge_intervals", _MERGED)
def wn6(s, d):
    return W.merge_intervals(ivals(s, d), ["k"], "b", "e")


def _grid(s, d):
    seen = obs(s, d).where("value is not null").select("instance", "position")
    return J.grid_join(obs(s, d).select("instance").distinct(), ["instance"], F.lit(1), F.lit(50), seen)


_GRID = """(SELECT i.instance, p.position, count(o.value) AS n FROM (SELECT DISTINCT instance FROM obs) i CROSS JOIN (SELECT unnest(range(1, 51)) AS position) p LEFT JOIN obs o ON o.instance = i.instance AND o.position = p.position GROUP BY ALL)"""


@query("WN7_missing_runs", f"""WITH r AS (SELECT instance, min(position) AS a, max(position) AS b FROM (SELECT instance, position, position - row_number() OVER (PARTITION BY instance ORDER BY position) AS i FROM {_GRID} WHERE n = 0) GROUP BY instance, i), t AS (SELECT *, b - a + 1 AS len, a = 1 OR b = 50 AS terminal FROM r)
SELECT instance, count(*) FILTER (NOT terminal) AS n_internal, coalesce(sum(len) FILTER (NOT terminal), 0)::BIGINT AS len_internal, count(*) FILTER (terminal) AS n_terminal, coalesce(sum(len) FILTER (terminal), 0)::BIGINT AS len_terminal, max(len) AS longest FROM t GROUP BY instance""")
def wn7(s, d):
    return W.missing_runs(_grid(s, d), ["instance"], "position", c("n") == 0)


@query("WN8_terminal_gaps", f"""SELECT instance, min(position) FILTER (n > 0) - 1 AS leading, 50 - max(position) FILTER (n > 0) AS trailing, max(position) FILTER (n > 0) - min(position) FILTER (n > 0) + 1 - count(*) FILTER (n > 0) AS interior_missing FROM {_GRID} GROUP BY instance""")
def wn8(s, d):
    return W.terminal_gaps(_grid(s, d), ["instance"], "position", c("n") > 0)


_P = """(SELECT unit, segment, round(abs(v), 6) / 5 AS p FROM unitseg)"""
_BH = f"""(SELECT *, least(1.0, min(p * n / rk) OVER (PARTITION BY unit ORDER BY p, segment ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY p, segment) AS rk, count(*) OVER (PARTITION BY unit) AS n FROM {_P}))"""


def _p(s, d):
    return unitseg(s, d).select("unit", "segment", (F.round(F.abs("v"), 6) / 5).alias("p"))


@query("WN9_bh_fdr", f"""SELECT unit, segment, round(p, 6) AS p, round(q, 6) AS q FROM {_BH}""")
def wn9(s, d):
    return W.bh_fdr(_p(s, d), "p", ["unit"], ["segment"]).select("unit", "segment", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"))


@query("WN10_fdr_audit", f"""SELECT unit, segment, n AS family_size, rk AS family_rank, row_number() OVER (ORDER BY p, unit, segment) AS global_rank, true AS agrees FROM {_BH}""")
def wn10(s, d):
    return W.fdr_audit(W.bh_fdr(_p(s, d), "p", ["unit"], ["segment"]), "p", "q", ["unit"], ["segment"]).select("unit", "segment", "family_size", "family_rank", "global_rank", "agrees")


@query("WN11_rank_min_desc", """SELECT unit, segment, rank() OVER (PARTITION BY unit ORDER BY round(v, 1) DESC) AS rank FROM unitseg""")
def wn11(s, d):
    return W.rank_min_desc(unitseg(s, d).withColumn("v", F.round("v", 1)), ["unit"], "v").select("unit", "segment", "rank")


@query("WN12_top_bottom_share", """SELECT unit, entry, n >= 10 AND dr <= greatest(1, round_even(0.1 * n, 0)) AS is_top, n >= 10 AND ar <= greatest(1, round_even(0.1 * n, 0)) AS is_bottom FROM (SELECT unit, entry, count(*) OVER (PARTITION BY unit) AS n, row_number() OVER (PARTITION BY unit ORDER BY v DESC, entry) AS dr, row_number() OVER (PARTITION BY unit ORDER BY v, entry) AS ar FROM (SELECT unit, entry, count(*) AS v FROM prof GROUP BY ALL))""")
def wn12(s, d):
    e = prof(s, d).groupBy("unit", "entry").agg(F.count("*").alias("v"))
    return W.top_bottom_share(e, ["unit"], "v", "entry").select("unit", "entry", "is_top", "is_bottom")


@query("WN13_avg_rank", """SELECT unit, l, k, rank() OVER (PARTITION BY unit ORDER BY q) + (count(*) OVER (PARTITION BY unit, q) - 1) / 2.0 AS r FROM (SELECT unit, l_orderkey AS l, l_partkey AS k, quantity AS q FROM rec)""")
def wn13(s, d):
    r = rec(s, d).select("unit", c("l_orderkey").alias("l"), c("l_partkey").alias("k"), c("quantity").alias("q"))
    return W.avg_rank(r, ["unit"], "q").select("unit", "l", "k", "r")


@query("WN14_duplicate_flag", """SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS is_duplicate FROM lineitem""")
def wn14(s, d):
    return W.duplicate_flag(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey", "is_duplicate")


@query("WN15_fractional_position", """SELECT instance, position, round(((position - 1) // 10) * 100 + CASE WHEN count(*) OVER w > 1 THEN 100.0 * (row_number() OVER (PARTITION BY instance, (position - 1) // 10 ORDER BY position) - 1) / (count(*) OVER w - 1) ELSE 0 END, 6) AS fraction FROM obs WINDOW w AS (PARTITION BY instance, (position - 1) // 10)""")
def wn15(s, d):
    o = obs(s, d).withColumn("seg", F.floor((c("position") - 1) / 10))
    return W.fractional_position(o, ["instance", "seg"], c("seg"), "position").select("instance", "position", F.round("fraction", 6).alias("fraction"))


@query("WN16_components_for", """WITH v AS (SELECT unit, rank() OVER (PARTITION BY unit ORDER BY n DESC, segment) AS comp, n FROM (SELECT unit, segment, n_entries AS n FROM unitseg)), t AS (SELECT unit, comp, sum(n) OVER (PARTITION BY unit ORDER BY comp) / sum(n) OVER (PARTITION BY unit) AS cum FROM v)
SELECT unit, min(comp) FILTER (cum >= 0.5 - 1e-12) AS n_50, min(comp) FILTER (cum >= 0.8 - 1e-12) AS n_80 FROM t GROUP BY unit""")
def wn16(s, d):
    from pyspark.sql import Window

    v = unitseg(s, d).withColumn("comp", F.row_number().over(Window.partitionBy("unit").orderBy(F.desc("n_entries"), "segment")))
    return W.components_for(v, ["unit"], "comp", "n_entries", [0.5, 0.8])


@query("WN17_dedupe_ranked", """SELECT l_orderkey, label, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE label WHEN 'N' THEN 1 WHEN 'A' THEN 2 ELSE 3 END, l_partkey, l_linenumber, l_suppkey, value) AS rn FROM rec) WHERE rn = 1""")
def wn17(s, d):
    return W.dedupe_ranked(rec(s, d), ["l_orderkey"], "label", ["N", "A", "R"], ["l_partkey", "l_linenumber", "l_suppkey", "value"]).select("l_orderkey", "label", "l_partkey")


@query("WN18_first_by_time", """SELECT user_id, (min({'t': ts, 'v': event_type})).v AS first_event_type FROM events GROUP BY user_id""")
def wn18(s, d):
    return W.first_by_time(table(s, d, "events"), "user_id", "ts", "event_type")


@query("SO1_union_tables", """SELECT 'customer' AS kind, c_nationkey AS k FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier""")
def so1(s, d):
    a = table(s, d, "customer").select(F.lit("customer").alias("kind"), c("c_nationkey").alias("k"))
    return W.union_tables(a, table(s, d, "supplier").select(F.lit("supplier").alias("kind"), c("s_nationkey").alias("k")))


@query("SO2_partition_units", """SELECT p_partkey AS u, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45) THEN 'WITH_CANDIDATE' WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) THEN 'ZERO_RESULT' ELSE 'REST' END AS part FROM part""")
def so2(s, d):
    line = table(s, d, "lineitem").withColumnRenamed("l_partkey", "u")
    return W.partition_units(table(s, d, "part").withColumnRenamed("p_partkey", "u"), "u", line.where("l_returnflag = 'R' AND l_quantity > 45"), line.where("l_quantity > 49"))


@query("SO3_membership_lists", """SELECT lvl AS level, coalesce(string_agg(seg, ',' ORDER BY seg) FILTER (n >= lvl), '') AS retained, coalesce(string_agg(seg, ',' ORDER BY seg) FILTER (n < lvl), '') AS lost FROM (SELECT c_mktsegment || c_nationkey::VARCHAR AS seg, count(*) AS n FROM customer GROUP BY 1), (SELECT unnest([5, 10, 15]) AS lvl) GROUP BY lvl""")
def so3(s, d):
    g = table(s, d, "customer").groupBy(F.concat("c_mktsegment", c("c_nationkey").cast("string")).alias("seg")).agg(F.count("*").alias("n"))
    g = g.withColumn("level", F.explode(F.array(F.lit(5), F.lit(10), F.lit(15)))).withColumn("status", F.when(c("n") >= c("level"), "RETAINED").otherwise("LOST"))
    return W.membership_lists(g, "level", "status", "seg", ["RETAINED", "LOST"])


@query("Q01_require_columns", "SELECT n_nationkey, n_name FROM nation")
def q01(s, d):
    return Q.require_columns(table(s, d, "nation"), ["n_nationkey", "n_name"]).select("n_nationkey", "n_name")


@query("Q02_grain_check", """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def q02(s, d):
    return Q.duplicates(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("Q03_vocabulary_check", """SELECT label, count(*) AS n FROM rec WHERE label NOT IN ('A', 'N') GROUP BY label""")
def q03(s, d):
    return Q.vocabulary_violations(rec(s, d), "label", ["A", "N"])


@query("Q04_row_conservation", """SELECT (SELECT count(*) FROM obs) AS n_before, (SELECT count(*) FROM norm) AS n_after, true AS same""")
def q04(s, d):
    return Q.row_conservation(obs(s, d), norm(s, d), ["instance", "position", "value"])


@query("Q05_znorm_check", """SELECT count(*) FILTER (abs(m) > 1e-9) AS bad_mean, count(*) FILTER (abs(sd - 1) > 1e-9) AS bad_sd, sum(g)::BIGINT AS z_from_missing, 0 AS infinite FROM (SELECT instance, avg(z) AS m, stddev_pop(z) AS sd, count(*) FILTER (value IS NULL AND z IS NOT NULL) AS g FROM norm GROUP BY instance)""")
def q05(s, d):
    return Q.znorm_check(norm(s, d), "instance", "value", "z")


@query("Q06_cohort_rules", """SELECT 'positive_value' AS rule, count(*) FILTER (NOT coalesce(value > 0, false)) AS n_failed, count(*) FILTER (NOT coalesce(value > 0, false)) = 0 AS holds FROM obs UNION ALL SELECT 'on_grid', count(*) FILTER (NOT position BETWEEN 1 AND 50), count(*) FILTER (NOT position BETWEEN 1 AND 50) = 0 FROM obs""")
def q06(s, d):
    return Q.cohort_rules(obs(s, d), {"positive_value": c("value") > 0, "on_grid": c("position").between(1, 50)})


@query("Q07_identity_audit", """SELECT id, count(DISTINCT code) AS n_codes, count(DISTINCT name) AS n_names, count(DISTINCT src) AS n_sources, count(DISTINCT code) <= 1 AND count(DISTINCT name) <= 1 AS consistent FROM (SELECT n_nationkey AS id, n_regionkey AS code, n_name AS name, 'a' AS src FROM nation UNION ALL SELECT c_nationkey, NULL, 'NATION_' || (c_nationkey - c_nationkey % 20 // 19)::VARCHAR, 'b' FROM customer) GROUP BY id""")
def q07(s, d):
    n = table(s, d, "nation").select(c("n_nationkey").alias("id"), c("n_regionkey").alias("code"), c("n_name").alias("name"))
    k = c("c_nationkey")
    other = table(s, d, "customer").select(k.alias("id"), F.lit(None).cast("int").alias("code"), F.concat(F.lit("NATION_"), (k - F.floor(k % 20 / 19)).cast("string")).alias("name"))
    return Q.identity_audit({"a": n, "b": other}, "id", "code", "name")


@query("Q08_reference_check", """SELECT k, b, e FROM ivals WHERE k % 5 = 0 OR b < 20 OR b > 280""")
def q08(s, d):
    ref = ivals(s, d).select("k").distinct().where("k % 5 <> 0").select("k", F.lit(20).alias("lo"), F.lit(280).alias("hi"))
    return Q.reference_check(ivals(s, d), ref, ["k"], "b", "lo", "hi")


@query("Q09_monotone_check", """SELECT instance, count(*) AS mapped, count(value) AS usable, count(*) FILTER (position > 10) AS late FROM obs GROUP BY instance HAVING count(*) < count(value) OR count(value) < count(*) FILTER (position > 10)""")
def q09(s, d):
    """Instances with fewer usable positions than late ones break the order that is claimed."""
    g = obs(s, d).groupBy("instance").agg(F.count("*").alias("mapped"), F.count("value").alias("usable"), F.count(F.when(c("position") > 10, 1)).alias("late"))
    return Q.monotone_check(g, ["mapped", "usable", "late"])


@query("Q10_snapshot_agreement", """SELECT 'present' AS "column", count(*) FILTER (n_nationkey IS NULL OR s IS NULL) AS n_different FROM nation FULL JOIN (SELECT DISTINCT s_nationkey AS s FROM supplier) ON n_nationkey = s UNION ALL SELECT 'region', count(*) FILTER (n_regionkey <> s % 5) FROM nation JOIN (SELECT DISTINCT s_nationkey AS s FROM supplier) ON n_nationkey = s""")
def q10(s, d):
    a = table(s, d, "nation").select(c("n_nationkey").alias("k"), c("n_regionkey").alias("region"))
    b = table(s, d, "supplier").select(c("s_nationkey").alias("k")).distinct().withColumn("region", c("k") % 5)
    return Q.snapshot_agreement(a, b, "k", ["region"])
