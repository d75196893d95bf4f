"""Queries of the aggregation operators."""

from pyspark.sql import functions as F

from tierstats.operators import aggregate as A
from tierstats.operators import intervals as I
from tierstats.sources.fixtures import feat, ivals, lines, norm, obs, prof, rec, segment_of, table, unitseg

from .registry import query

c = F.col
R6 = lambda *cols: [F.round(x, 6).alias(x) for x in cols]


@query("AG1_pick_record", """SELECT instance, position, n_records, value FROM obs""")
def ag1(s, d):
    return obs(s, d).select("instance", "position", "n_records", "value")


_ARR = """(SELECT instance, position, list(occupancy ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, value) AS o FROM rec GROUP BY ALL)"""


@query("AG2_observation_flags", f"""SELECT instance, position, len(o) > 0 AS record_present, list_max(o) > 0 AS any_positive, list_max(o) > 0 AS usable, list_max(o) <= 0 AS zero_only, len(list_filter(o, lambda x: x > 0)) AS n_positive FROM {_ARR}""")
def ag2(s, d):
    g = rec(s, d).groupBy("instance", "position").agg(F.collect_list("occupancy").alias("o"), F.collect_list("value").alias("v"))
    return g.select("instance", "position", *(e.alias(n) for n, e in A.observation_flags(c("o"), c("v")).items()))


@query("AG1b_pick_from_arrays", """SELECT l_orderkey, min({'o': -occupancy, 'p': CASE WHEN label = 'A' THEN 1 ELSE 2 END, 'l': label, 'v': value}).v AS value FROM rec WHERE occupancy > 0 GROUP BY l_orderkey UNION ALL SELECT l_orderkey, NULL FROM rec GROUP BY l_orderkey HAVING max(occupancy) <= 0""")
def ag1b(s, d):
    g = rec(s, d).groupBy("l_orderkey").agg(F.collect_list("label").alias("l"), F.collect_list("occupancy").alias("o"), F.collect_list("value").alias("v"))
    return g.select("l_orderkey", A.pick_from_arrays(c("l"), c("o"), c("v"))["val"].alias("value"))


_AG3 = """SELECT instance, position, round(z, 6) AS z, CASE WHEN n_usable >= 2 THEN round(sd, 4) END AS sd, n_usable, CASE WHEN value IS NULL THEN 'VALUE_MISSING' WHEN n_usable < 2 THEN 'NOT_NORMALIZABLE_FEW_VALUES' WHEN sd <= 1e-12 THEN 'NOT_NORMALIZABLE_CONSTANT' ELSE 'NORMALIZED' END AS row_status FROM norm"""


@query("AG3_zscore_within", _AG3)
def ag3(s, d):
    return norm(s, d).select("instance", "position", F.round("z", 6).alias("z"), F.round("sd", 4).alias("sd"), "n_usable", "row_status")


@query("AG3b_zscore_hot_instances", _AG3)
def ag3b(s, d):
    """The same with instances of more than ten values refined by histograms."""
    z = A.zscore_within(obs(s, d), "instance", "value", plain_values=10)
    return z.select("instance", "position", F.round("z", 6).alias("z"), F.round("sd", 4).alias("sd"), "n_usable", "row_status")


@query("AG4_instance_summary", """SELECT instance, count(*) AS n_rows, count(value) AS n_usable, round(count(value) / count(*), 6) AS usable_fraction, round(avg(value), 6) AS mean, round(median(value), 4) AS median, round(avg((z > 1.5)::INT), 6) AS share_above, round(avg((z < -1.5)::INT), 6) AS share_below FROM norm GROUP BY instance""")
def ag4(s, d):
    g = A.instance_summary(norm(s, d).select("instance", "value", "z"), "instance", "value", "z")
    return g.select("instance", "n_rows", "n_usable", *R6("usable_fraction", "share_above", "share_below"), F.round("mean", 6).alias("mean"), F.round("median", 4).alias("median"))


@query("AG5_add_representative_columns", """SELECT c_custkey, c_name, n FROM customer LEFT JOIN (SELECT entry, count(*) AS n FROM obs GROUP BY entry) ON c_custkey = entry""")
def ag5(s, d):
    n = obs(s, d).groupBy(c("entry").alias("c_custkey")).agg(F.count("*").alias("n"))
    return A.add_columns(table(s, d, "customer"), n, "c_custkey", ["n"]).select("c_custkey", "c_name", "n")


@query("AG6_entry_attributes", """SELECT unit, entry, array_to_string(list_sort(list(DISTINCT label)), ',') AS states, CASE WHEN count(DISTINCT label) = 1 THEN min(label) ELSE 'AMBIGUOUS' END AS state, count(DISTINCT label) > 1 AS conflict, max(resolution) AS resolution, bool_or(occupancy = 0) AS any_member FROM rec GROUP BY unit, entry""")
def ag6(s, d):
    g = A.entry_attributes(rec(s, d), ["unit", "entry"], "label", "resolution", c("occupancy") == 0)
    return g.select("unit", "entry", F.concat_ws(",", "states").alias("states"), "state", "conflict", "resolution", "any_member")


@query("AG7_entry_position_profile", """SELECT entry, position, round(z, 6) AS z, n_instances FROM prof""")
def ag7(s, d):
    return prof(s, d).select("entry", "position", F.round("z", 6).alias("z"), "n_instances")


_AG8 = """SELECT unit, position, count(z) AS n, round(avg(z), 6) AS mean, round(median(z), 6) AS median, round(stddev_samp(z), 6) AS sd, round(quantile_cont(z, 0.25), 6) AS q25, round(quantile_cont(z, 0.75), 6) AS q75, round(median(z) FILTER (state = 'HOLO') - median(z) FILTER (state = 'APO'), 6) AS delta FROM prof GROUP BY unit, position"""


@query("AG8_unit_position_profile", _AG8)
def ag8(s, d):
    g = A.unit_position_profile(prof(s, d), ["unit", "position"], "z", "state")
    return g.select("unit", "position", "n", *R6("mean", "median", "sd", "q25", "q75", "delta"))


@query("AG8b_profile_hot_groups", _AG8)
def ag8b(s, d):
    """The same with groups of more than 25 values refined by histograms."""
    g = A.unit_position_profile(prof(s, d), ["unit", "position"], "z", "state", plain_values=25)
    return g.select("unit", "position", "n", *R6("mean", "median", "sd", "q25", "q75", "delta"))


@query("AG9_unit_summary", """SELECT n_nationkey AS unit, coalesce(n_positions, 0) AS n_positions, coalesce(n3, 0) AS n_at_3, coalesce(n5, 0) AS n_at_5, coalesce(n10, 0) AS n_at_10, round(hi, 6) AS share_high, CASE WHEN coalesce(n_positions, 0) = 0 THEN 'NO_DATA' WHEN n3 = 0 THEN 'INSUFFICIENT' ELSE 'PROFILED' END AS status FROM nation LEFT JOIN (SELECT unit, count(*) AS n_positions, count(*) FILTER (n >= 3) AS n3, count(*) FILTER (n >= 5) AS n5, count(*) FILTER (n >= 10) AS n10, avg((m > 1)::INT) AS hi FROM (SELECT unit, position, count(*) AS n, median(round(z, 9)) AS m FROM prof GROUP BY ALL) GROUP BY unit) ON unit = n_nationkey""")
def ag9(s, d):
    # rounded, as the z of two values is 1 but for its last bit, which hangs on the order of the rows
    u = A.unit_summary(table(s, d, "nation").select(c("n_nationkey").alias("unit")), "unit", prof(s, d).withColumn("z", F.round("z", 9)), "z")
    return u.select("unit", "n_positions", "n_at_3", "n_at_5", "n_at_10", F.round("share_high", 6).alias("share_high"), "status")


@query("AG10_segment_definitions", """SELECT 'S' || ((p_size - 1) // 10)::VARCHAR AS segment, (p_size - 1) // 10 AS ord, count(*) AS n FROM part GROUP BY ALL""")
def ag10(s, d):
    p = table(s, d, "part").select(segment_of(c("p_size")).alias("segment"), F.floor((c("p_size") - 1) / 10).alias("ord"))
    return A.constants(p, ["segment"], ["ord"])


def _segpos(s, d):
    return table(s, d, "part").select(c("p_size").alias("position")).distinct().withColumn("segment", segment_of(c("position")))


@query("AG11_segment_coverage", """SELECT entry, segment, n_observed, n_expected, round(n_observed / n_expected, 6) AS coverage FROM (SELECT entry, 'S' || ((position - 1) // 10)::VARCHAR AS segment, count(DISTINCT position) AS n_observed FROM obs WHERE value IS NOT NULL GROUP BY ALL) JOIN (SELECT 'S' || ((p - 1) // 10)::VARCHAR AS segment, count(*) AS n_expected FROM (SELECT DISTINCT p_size AS p FROM part) GROUP BY 1) USING (segment)""")
def ag11(s, d):
    g = A.segment_coverage(obs(s, d).where("value is not null").select("entry", "position"), ["entry"], _segpos(s, d), "segment", "position")
    return g.select("entry", "segment", "n_observed", "n_expected", F.round("coverage", 6).alias("coverage"))


@query("AG12_entry_segment_features", """SELECT entry, segment, count(*) AS n, round(avg(z), 6) AS mean, round(median(z), 6) AS median, round(stddev_pop(z), 6) AS sd, round(quantile_cont(z, 0.75) - quantile_cont(z, 0.25), 6) AS iqr FROM (SELECT *, 'S' || ((position - 1) // 10)::VARCHAR AS segment FROM prof) GROUP BY entry, segment""")
def ag12(s, d):
    p = prof(s, d).withColumn("segment", segment_of(c("position")))
    return A.entry_segment_features(p, ["entry", "segment"], "z").select("entry", "segment", "n", *R6("mean", "median", "sd", "iqr"))


@query("AG13_unit_segment_profile", """SELECT unit, segment, count(*) AS n_entries, round(median(v), 6) AS median_of_medians, round(avg(v), 6) AS mean_of_medians, round(median(mean_v), 6) AS median_of_means, round(stddev_pop(v), 6) AS sd, round(median(v) FILTER (state = 'APO'), 6) AS median_apo, round(median(v) FILTER (state = 'HOLO'), 6) AS median_holo, round(count(*) / any_value(a), 6) AS support FROM feat JOIN (SELECT c_nationkey AS unit, count(*) AS a FROM customer GROUP BY 1) USING (unit) GROUP BY unit, segment""")
def ag13(s, d):
    g = A.unit_segment_profile(feat(s, d), ["unit", "segment"], "v", "mean_v", "state", table(s, d, "customer").withColumnRenamed("c_nationkey", "unit"), "unit")
    return g.select("unit", "segment", "n_entries", *R6("median_of_medians", "mean_of_medians", "median_of_means", "sd", "median_apo", "median_holo", "support"))


@query("AG14_pivot_matrix", """SELECT entry, round(max(v) FILTER (segment = 'S0'), 6) AS "S0", round(max(v) FILTER (segment = 'S1'), 6) AS "S1", round(max(v) FILTER (segment = 'S2'), 6) AS "S2", round(max(v) FILTER (segment = 'S3'), 6) AS "S3", round(max(v) FILTER (segment = 'S4'), 6) AS "S4" FROM feat GROUP BY entry""")
def ag14(s, d):
    names = [f"S{i}" for i in range(5)]
    return A.pivot_matrix(feat(s, d), "entry", "segment", "v", names).select("entry", *R6(*names))


@query("AG15_matrix_missingness", """SELECT segment, count(DISTINCT entry) AS n_observed, (SELECT count(*) FROM customer) AS n_rows, round(1 - count(DISTINCT entry) / (SELECT count(*) FROM customer), 6) AS missing FROM feat GROUP BY segment""")
def ag15(s, d):
    g = A.matrix_missingness(feat(s, d), table(s, d, "customer"), "entry", "segment")
    return g.select("segment", "n_observed", "n_rows", F.round("missing", 6).alias("missing"))


_QC = """(SELECT unit, entry, instance, count(*) AS n_mapped, count(value) AS n_usable, round(count(value) / 50, 6) AS cov FROM obs GROUP BY ALL)"""


def _qc(s, d):
    g = A.instance_qc(obs(s, d), "instance", F.lit(True), c("n_records") > 0, c("value").isNotNull(), c("value") > 0, F.lit(50))
    return g.join(obs(s, d).select("unit", "entry", "instance").distinct(), "instance").withColumn("cov", c("usable_coverage"))


@query("AG16_instance_qc", f"""SELECT instance, n_mapped, n_usable, cov AS usable_coverage, n_usable = 50 AS complete FROM {_QC}""")
def ag16(s, d):
    return _qc(s, d).select("instance", "n_mapped", "n_usable", "usable_coverage", "complete")


@query("AG17_candidate_rollup", f"""SELECT entry, count(*) AS n_instances, min(cov) AS min_coverage, max(cov) AS max_coverage, round(median(cov), 6) AS median_coverage, bool_or(n_usable > 8) AS any_complete, bool_and(n_usable > 8) AS all_complete FROM {_QC} GROUP BY entry""")
def ag17(s, d):
    g = A.candidate_rollup(_qc(s, d).withColumn("big", c("n_usable") > 8), ["entry"], "cov", "big")
    return g.withColumn("median_coverage", F.round("median_coverage", 6))


@query("AG18_counts_by_unit", """SELECT n_nationkey AS unit, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation""")
def ag18(s, d):
    return A.counts_by_unit(table(s, d, "nation").select(c("n_nationkey").alias("unit")), "unit", {"customers": table(s, d, "customer").withColumnRenamed("c_nationkey", "unit"), "suppliers": table(s, d, "supplier").withColumnRenamed("s_nationkey", "unit")})


@query("AG19_threshold_sensitivity", f"""SELECT level, count(DISTINCT instance) FILTER (cov >= level) AS n_instances, count(DISTINCT entry) FILTER (cov >= level) AS n_entries, count(DISTINCT unit) FILTER (cov >= level) AS n_units, array_to_string(list_filter(list_sort(list(DISTINCT unit)), lambda u: NOT list_contains(coalesce(list(DISTINCT unit) FILTER (cov >= level), []), u)), ',') AS lost FROM {_QC}, (SELECT unnest([0.1, 0.3, 0.5]::DOUBLE[]) AS level) GROUP BY level""")
def ag19(s, d):
    return A.threshold_sensitivity(_qc(s, d), [0.1, 0.3, 0.5], "cov", "instance", "entry", "unit")


@query("AG20_threshold_attrition", f"""SELECT n_nationkey AS unit, level, best, CASE WHEN best IS NULL THEN 'NO_DATA' WHEN best >= level THEN 'RETAINED' ELSE 'LOST' END AS status FROM nation LEFT JOIN (SELECT unit, max(cov) AS best FROM {_QC} GROUP BY unit) ON unit = n_nationkey, (SELECT unnest([0.2, 0.4, 0.6]::DOUBLE[]) AS level)""")
def ag20(s, d):
    return A.threshold_attrition(_qc(s, d), table(s, d, "nation").select(c("n_nationkey").alias("unit")), [0.2, 0.4, 0.6], "cov", "unit")


@query("AG21_any_all_threshold", f"""SELECT entry, bool_or(cov >= 0.2) AS any_ge, bool_and(cov >= 0.2) AS all_ge FROM {_QC} GROUP BY entry""")
def ag21(s, d):
    return A.any_all_threshold(_qc(s, d), ["entry"], "cov", 0.2)


@query("AG22_heterogeneity", f"""SELECT entry, count(*) AS n, round(max(cov) - min(cov), 6) AS spread, max(cov) - min(cov) >= 0.15 AS heterogeneous FROM {_QC} GROUP BY entry HAVING count(*) > 1""")
def ag22(s, d):
    return A.heterogeneity(_qc(s, d), ["entry"], "cov", 0.15).withColumn("spread", F.round("spread", 6))


@query("AG23_change_audit", """SELECT entry, count(*) FILTER (value > 30000) AS n_before, count(*) FILTER (value > 30000 AND n_records = 1) AS n_after FROM obs GROUP BY entry HAVING count(*) FILTER (value > 30000) <> count(*) FILTER (value > 30000 AND n_records = 1)""")
def ag23(s, d):
    return A.change_audit(obs(s, d), ["entry"], c("value") > 30000, (c("value") > 30000) & (c("n_records") == 1))


@query("AG24_vote_consensus", """SELECT *, CASE WHEN "n_N" >= "n_A" AND "n_N" >= "n_R" THEN 'N' WHEN "n_A" >= "n_R" THEN 'A' ELSE 'R' END AS winner, round(greatest("n_N", "n_A", "n_R") / n_votes, 6) AS fraction FROM (SELECT unit, position, count(*) AS n_votes, count(DISTINCT entry) AS n_voters, count(*) FILTER (label = 'N') AS "n_N", count(*) FILTER (label = 'A') AS "n_A", count(*) FILTER (label = 'R') AS "n_R" FROM rec GROUP BY unit, position)""")
def ag24(s, d):
    return A.vote_consensus(rec(s, d), ["unit", "position"], "label", ["N", "A", "R"], "entry").withColumn("fraction", F.round("fraction", 6))


@query("AG25_contact_consensus", """SELECT *, round(n_contacting / n_entries, 6) AS fraction, n_contacting / n_entries >= 0.1 AS ge_10, n_contacting / n_entries >= 0.25 AS ge_25, n_contacting / n_entries >= 0.5 AS ge_50 FROM (SELECT unit, position, count(DISTINCT entry) AS n_entries, count(DISTINCT entry) FILTER (quantity > 35) AS n_contacting FROM rec GROUP BY ALL) WHERE n_entries >= 3""")
def ag25(s, d):
    return A.contact_consensus(rec(s, d), ["unit", "position"], "entry", c("quantity") > 35).withColumn("fraction", F.round("fraction", 6))


@query("AG26_dominance", """SELECT unit, count(*) AS n_labels, (min({'n': -n, 'l': label})).l AS top_label, round(max(n) / sum(n), 6) AS share, max(n) / sum(n) > 0.5 AS dominated FROM (SELECT unit, label, count(*) AS n FROM rec GROUP BY ALL) GROUP BY unit""")
def ag26(s, d):
    return A.dominance(rec(s, d), ["unit"], "label").withColumn("share", F.round("share", 6))


@query("AG27_stratify", """SELECT grp, state, count(*) AS n, round(median(v), 6) AS median, grouping(state) AS total FROM feat GROUP BY GROUPING SETS ((grp), (grp, state))""")
def ag27(s, d):
    return A.stratify(feat(s, d), "grp", "state", "v").withColumn("median", F.round("median", 6))


@query("AG28_anomaly_union", """SELECT 'ZERO_OCCUPANCY' AS anomaly, entry::VARCHAR AS key, count(*) AS n FROM rec WHERE occupancy = 0 GROUP BY 2 UNION ALL SELECT 'SMALL', entry::VARCHAR, count(*) FROM rec WHERE quantity < 3 GROUP BY 2""")
def ag28(s, d):
    r = rec(s, d)
    return A.anomaly_union({"ZERO_OCCUPANCY": r.where("occupancy = 0"), "SMALL": r.where("quantity < 3")}, "entry")


@query("AG29_state_eligibility", """SELECT n_nationkey AS unit, coalesce(a, 0) AS n_apo, coalesce(h, 0) AS n_holo, coalesce(m, 0) AS n_ambiguous, CASE WHEN least(coalesce(a, 0), coalesce(h, 0)) >= 14 THEN 'PRIMARY' WHEN least(coalesce(a, 0), coalesce(h, 0)) >= 10 THEN 'EXPLORATORY' ELSE 'NOT_ELIGIBLE' END AS tier FROM nation LEFT JOIN (SELECT unit, count(*) FILTER (state = 'APO') AS a, count(*) FILTER (state = 'HOLO') AS h, count(*) FILTER (state = 'AMBIGUOUS') AS m FROM (SELECT DISTINCT unit, entry, state FROM obs) GROUP BY unit) ON unit = n_nationkey""")
def ag29(s, d):
    e = obs(s, d).select("unit", "entry", "state").distinct()
    return A.state_eligibility(table(s, d, "nation").select(c("n_nationkey").alias("unit")), e, "unit", "state", (14, 10))


_EFFECT = """(SELECT unit, segment, round(median(v) FILTER (state = 'HOLO') - median(v) FILTER (state = 'APO'), 6) AS delta FROM feat GROUP BY ALL)"""


def _effect(s, d):
    g = feat(s, d).groupBy("unit", "segment").agg((F.median(F.when(c("state") == "HOLO", c("v"))) - F.median(F.when(c("state") == "APO", c("v")))).alias("delta"))
    return g.withColumn("delta", F.round("delta", 6)).where("delta is not null")


@query("AG30_effect_summary", f"""SELECT unit, count(*) AS n_tested, round(median(delta), 6) AS median_delta, round(avg((delta > 0)::INT), 6) AS share_up, round(avg((delta < 0)::INT), 6) AS share_down, (min({{'d': delta, 's': segment}})).s AS lowest, (min({{'d': -delta, 's': segment}})).s AS highest FROM {_EFFECT} WHERE delta IS NOT NULL GROUP BY unit""")
def ag30(s, d):
    g = A.effect_summary(_effect(s, d), "unit", "segment", "delta")
    return g.select("unit", "n_tested", *R6("median_delta", "share_up", "share_down"), "lowest", "highest")


@query("AG31_overrepresentation", """SELECT unit, n, row_number() OVER (ORDER BY n DESC, unit) AS rank, round((SELECT sum(n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey ORDER BY count(*) DESC, c_nationkey LIMIT 5)) / sum(n) OVER (), 6) AS top_share FROM (SELECT c_nationkey AS unit, count(*) AS n FROM customer GROUP BY 1)""")
def ag31(s, d):
    return A.overrepresentation(table(s, d, "customer").withColumnRenamed("c_nationkey", "unit"), "unit").withColumn("top_share", F.round("top_share", 6))


_VOC = """(SELECT unnest(['S0', 'S1', 'S2', 'S3', 'S4', 'S9']) AS segment)"""


def _support(s, d):
    voc = s.createDataFrame([(f"S{i}",) for i in (0, 1, 2, 3, 4, 9)], "segment string")
    return A.feature_support(unitseg(s, d), voc, "segment", "unit", 25)


@query("AG32_feature_support", f"""SELECT segment, coalesce(n, 0) AS n_units, m AS median_entries, round(coalesce(n, 0) / 25, 6) AS support FROM {_VOC} LEFT JOIN (SELECT segment, count(DISTINCT unit) AS n, median(n_entries) AS m FROM unitseg GROUP BY segment) USING (segment)""")
def ag32(s, d):
    return _support(s, d).withColumn("support", F.round("support", 6))


@query("AG33_candidate_feature_sets", f"""WITH sup AS (SELECT segment, coalesce(n, 0) / 25 AS support FROM {_VOC} LEFT JOIN (SELECT segment, count(DISTINCT unit) AS n FROM unitseg GROUP BY segment) USING (segment)), lv AS (SELECT segment, level FROM sup, (SELECT unnest([0.4, 0.7]::DOUBLE[]) AS level) WHERE support >= level), nf AS (SELECT level, count(*) AS nf FROM lv GROUP BY level), hv AS (SELECT level, unit, count(*) AS have FROM lv JOIN (SELECT DISTINCT unit, segment FROM unitseg) USING (segment) GROUP BY ALL)
SELECT level, count(*) FILTER (have = nf) AS complete_units, max(nf) AS n_features FROM hv JOIN nf USING (level) GROUP BY level""")
def ag33(s, d):
    return A.candidate_feature_sets(_support(s, d), unitseg(s, d), "segment", "unit", [0.4, 0.7])


@query("AG34_cohort_rule", """SELECT c_custkey AS entry, coalesce(n, 0) AS n_observed, round(coalesce(n, 0) / 4, 6) AS observed_fraction, coalesce(n, 0) / 4 >= 0.6 AS included, CASE WHEN coalesce(n, 0) / 4 >= 0.6 THEN 'ENOUGH_OBSERVED' WHEN coalesce(n, 0) = 0 THEN 'NOTHING_OBSERVED' ELSE 'TOO_FEW_OBSERVED' END AS reason FROM customer LEFT JOIN (SELECT entry, count(DISTINCT segment) AS n FROM feat WHERE segment IN ('S0', 'S1', 'S2', 'S3') GROUP BY entry) ON entry = c_custkey""")
def ag34(s, d):
    g = A.cohort_rule(feat(s, d), table(s, d, "customer").select(c("c_custkey").alias("entry")), "entry", ["S0", "S1", "S2", "S3"], "segment")
    return g.withColumn("observed_fraction", F.round("observed_fraction", 6))


@query("AG35_crosstab_2x2", """SELECT grp, count(*) FILTER (a AND b) AS n11, count(*) FILTER (a AND NOT b) AS n10, count(*) FILTER (NOT a AND b) AS n01, count(*) FILTER (NOT a AND NOT b) AS n00, least(count(*) FILTER (a), count(*) FILTER (NOT a), count(*) FILTER (b), count(*) FILTER (NOT b)) = 0 AS degenerate FROM (SELECT grp, quantity > 25 AS a, label = 'R' AS b FROM rec) GROUP BY grp""")
def ag35(s, d):
    return A.crosstab_2x2(rec(s, d), ["grp"], c("quantity") > 25, c("label") == "R")


@query("AG36_union_coverage", """WITH m AS (SELECT k, count(*) AS n_regions FROM ivals GROUP BY k), u AS (SELECT k, count(DISTINCT p) AS len FROM (SELECT k, unnest(range(b, e + 1)) AS p FROM ivals) GROUP BY k) SELECT k, n_regions, len AS union_length, round(len / 400, 6) AS coverage FROM m JOIN u USING (k)""")
def ag36(s, d):
    return I.union_coverage(ivals(s, d), ["k"], "b", "e", F.lit(400)).withColumn("coverage", F.round("coverage", 6))


@query("AG37_short_mapping", """WITH u AS (SELECT k, count(DISTINCT p) AS len FROM (SELECT k, unnest(range(b, e + 1)) AS p FROM lines) GROUP BY k) SELECT k, len AS union_length, round(len / 400, 6) AS coverage FROM u WHERE len < 30 OR len / 400 < 0.05""")
def ag37(s, d):
    return I.short_mapping(lines(s, d), ["k"], "b", "e", F.lit(400)).select("k", "union_length", F.round("coverage", 6).alias("coverage"))


@query("AG38_naive_mapping", """SELECT k, sum(e - b + 1)::BIGINT AS summed, round(sum(e - b + 1) / 400, 6) AS coverage, sum(e - b + 1) / 400 > 1 AS double_counted FROM ivals GROUP BY k""")
def ag38(s, d):
    return I.naive_mapping(ivals(s, d), ["k"], "b", "e", F.lit(400)).withColumn("coverage", F.round("coverage", 6))


@query("AG39_missingness_profile", """SELECT bin, count(*) AS n, round(median(missing), 6) AS median_missing, max(missing) AS max_missing FROM (SELECT n - u AS missing, CASE WHEN u / n = 1 THEN 'ALL' WHEN u / n < 0.5 THEN 'FEW' WHEN u / n < 0.9 THEN 'MOST' ELSE 'NEARLY' END AS bin FROM (SELECT instance, count(*) AS n, count(value) AS u FROM obs GROUP BY instance)) GROUP BY bin""")
def ag39(s, d):
    q = obs(s, d).groupBy("instance").agg(F.count("*").alias("n"), F.count("value").alias("u"))
    return A.missingness_profile(q, "n", "u", [0.0, 0.5, 0.9, 1.0], ["FEW", "MOST", "NEARLY"]).withColumn("median_missing", F.round("median_missing", 6))


@query("AG40_support_totals", """SELECT unit, sum(a)::BIGINT AS n_apo, sum(h)::BIGINT AS n_holo, CASE WHEN sum(a) + sum(h) = 0 THEN 'NO_DATA' WHEN least(sum(a), sum(h)) >= 12 THEN 'ADEQUATE' ELSE 'INSUFFICIENT' END AS balance FROM (SELECT DISTINCT unit, entry, (state = 'APO')::INT AS a, (state = 'HOLO')::INT AS h FROM obs) GROUP BY ROLLUP (unit)""")
def ag40(s, d):
    e = obs(s, d).select("unit", "entry", (c("state") == "APO").cast("int").alias("n_apo"), (c("state") == "HOLO").cast("int").alias("n_holo")).distinct()
    return A.support_totals(e, "unit", ["n_apo", "n_holo"], 12)


@query("AG41_selected_map", """SELECT instance, position, value FROM obs WHERE instance IN (SELECT instance FROM obs GROUP BY instance HAVING count(value) >= 12)""")
def ag41(s, d):
    o = obs(s, d).select("instance", "position", "value")
    return A.selected_map(o, o.groupBy("instance").agg(F.count("value").alias("n")).where("n >= 12"), "instance")


@query("AG42_list_partners", """SELECT n_nationkey, p IS NOT NULL AS has_partner, coalesce(p, '') AS partners FROM nation LEFT JOIN (SELECT s_nationkey, string_agg(DISTINCT x, '; ' ORDER BY x) AS p FROM (SELECT s_nationkey, CASE WHEN s_acctbal > 0 THEN 'IN' ELSE 'OUT' END || ' (' || s_name || ')' AS x FROM supplier) GROUP BY 1) ON s_nationkey = n_nationkey""")
def ag42(s, d):
    sup = table(s, d, "supplier").select(c("s_nationkey").alias("n_nationkey"), F.when(c("s_acctbal") > 0, "IN").otherwise("OUT").alias("cat"), "s_name")
    return A.list_partners(sup, table(s, d, "nation").select("n_nationkey"), "n_nationkey", "cat", "s_name")


@query("AG43_dataset_summary", """SELECT count(*) AS n_units, sum(rows)::BIGINT AS n_rows, sum(n)::BIGINT AS n_entries, count(*) FILTER (n <= 2) AS units_1_2, count(*) FILTER (n >= 3) AS units_3_up FROM (SELECT entry, count(DISTINCT instance) AS n, count(*) AS rows FROM obs GROUP BY entry)""")
def ag43(s, d):
    return A.dataset_summary(obs(s, d), "entry", "instance")
