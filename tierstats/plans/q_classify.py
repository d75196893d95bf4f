"""Queries of the classification operators over arrays of taxes and discounts by order, documents and lines."""

from pyspark.sql import functions as F

from tierstats.operators import classify as C
from tierstats.sources.fixtures import arrs, ivals, obs, rec, table

from .registry import query

c = F.col


@query("PF1_range_status", """SELECT k, CASE WHEN len(taxes) > 1 THEN 'MULTI_VALUE_REVIEW' WHEN taxes[1] < 0.02 THEN 'BELOW' WHEN taxes[1] > 0.06 THEN 'ABOVE' ELSE 'PASS' END AS status FROM arrs""")
def pf1(s, d):
    return arrs(s, d).select("k", C.range_status(c("taxes"), 0.02, 0.06).alias("status"))


@query("PF2_all_le_status", """SELECT k, CASE WHEN list_max(discounts) <= 0.05 THEN 'PASS_ALL' WHEN list_min(discounts) > 0.05 THEN 'FAIL_ALL' ELSE 'MIXED' END AS status FROM arrs""")
def pf2(s, d):
    return arrs(s, d).select("k", C.all_le_status(c("discounts"), 0.05).alias("status"))


@query("PF3_bin_by_edges", """SELECT bin, count(*) AS n FROM (SELECT CASE WHEN l_discount = 0.1 THEN 'TOP' WHEN l_discount >= 0 AND l_discount < 0.03 THEN 'LOW' WHEN l_discount >= 0.03 AND l_discount < 0.07 THEN 'MID' WHEN l_discount >= 0.07 AND l_discount < 0.1 THEN 'HIGH' END AS bin FROM lineitem) GROUP BY bin""")
def pf3(s, d):
    b = C.bin_by_edges(c("l_discount"), [0.0, 0.03, 0.07, 0.1], ["LOW", "MID", "HIGH"], exact_top="TOP")
    return table(s, d, "lineitem").select(b.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


@query("PF4_threshold_flags", """SELECT instance, position, value >= 20000 AS v_2000000, value >= 50000 AS v_5000000 FROM obs""")
def pf4(s, d):
    return obs(s, d).select("instance", "position", *C.threshold_flags(c("value"), [20000, 50000], "v"))


def _reasons():
    return {"FEW_LINES": F.size("taxes") < 2, "TAX_HIGH": F.get("taxes", F.size("taxes") - 1) > 0.07, "NO_DISCOUNT": F.array_max("discounts") == 0}


_REASONS = """(SELECT k, list_filter([CASE WHEN len(taxes) < 2 THEN 'FEW_LINES' END, CASE WHEN list_max(taxes) > 0.07 THEN 'TAX_HIGH' END, CASE WHEN list_max(discounts) = 0 THEN 'NO_DISCOUNT' END], lambda x: x IS NOT NULL) AS reasons FROM arrs)"""


@query("PF5_reason_codes", f"""SELECT k, array_to_string(reasons, ';') AS reasons, CASE WHEN len(reasons) = 0 THEN 'SELECTED' ELSE 'EXCLUDED' END AS status FROM {_REASONS}""")
def pf5(s, d):
    a = arrs(s, d).withColumn("reasons", C.reason_codes(_reasons()))
    return a.select("k", F.concat_ws(";", "reasons").alias("reasons"), C.selection_status(c("reasons"), F.lit(True)).alias("status"))


@query("PF6_reason_counts", f"""SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM {_REASONS}) GROUP BY reason""")
def pf6(s, d):
    return C.reason_counts(arrs(s, d).withColumn("reasons", C.reason_codes(_reasons())), "reasons")


@query("PF7_select_pool", """SELECT k, CASE WHEN len(taxes) > 2 AND list_max(discounts) >= 0.08 THEN 'SELECTED' WHEN len(taxes) > 2 THEN 'NOT_DEEP' WHEN list_max(discounts) >= 0.08 THEN 'NOT_MANY' ELSE 'NEITHER' END AS pool FROM arrs""")
def pf7(s, d):
    return arrs(s, d).select("k", C.select_pool(F.size("taxes") > 2, F.array_max("discounts") >= 0.08, ("MANY", "DEEP")).alias("pool"))


@query("PF8_sensitivity_views", """SELECT k, len(taxes) >= 3 AS stricter, len(taxes) >= 1 AS looser, NOT (list_max(discounts) > 0.05) AS inverted FROM arrs""")
def pf8(s, d):
    n = F.size("taxes")
    return C.sensitivity_views(arrs(s, d), {"stricter": n >= 3, "looser": n >= 1, "inverted": ~(F.array_max("discounts") > 0.05)}).select("k", "stricter", "looser", "inverted")


@query("PF9_override_lookup", """SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 'EXC_' || (n_nationkey % 3)::VARCHAR ELSE 'DEFAULT' END AS class FROM nation""")
def pf9(s, d):
    n = table(s, d, "nation")
    over = n.where("n_regionkey = 2").select("n_nationkey", F.concat(F.lit("EXC_"), (c("n_nationkey") % 3).cast("string")).alias("class"))
    return C.override_lookup(n, over, "n_nationkey", F.lit("DEFAULT"), c("n_regionkey") == 2, "class").select("n_nationkey", "class")


@query("PF10_evidence_cascade", """SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' AND p_size > 40 THEN 'BULK' WHEN p_retailprice > 1500 THEN 'PREMIUM' WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'HOUSE' WHEN p_size < 5 THEN 'SMALL' ELSE 'PLAIN' END AS class FROM part""")
def pf10(s, d):
    rules = [((c("p_type") == "ECONOMY") & (c("p_size") > 40), "BULK"), (c("p_retailprice") > 1500, "PREMIUM"), (c("p_brand").isin("Brand#1", "Brand#2"), "HOUSE"), (c("p_size") < 5, "SMALL")]
    return table(s, d, "part").select("p_partkey", C.evidence_cascade(rules, "PLAIN").alias("class"))


@query("PF11_state_from_evidence", """SELECT entry, CASE WHEN NOT bool_or(occupancy > 0) THEN 'AMBIGUOUS' WHEN bool_or(occupancy > 0 AND label = 'R' AND position <= 5) THEN 'HOLO' WHEN bool_or(occupancy > 0 AND label = 'A' AND position <= 2) THEN 'AMBIGUOUS' ELSE 'APO' END AS state FROM rec GROUP BY entry""")
def pf11(s, d):
    return C.state_from_evidence(rec(s, d), ["entry"], c("occupancy") > 0, (c("label") == "R") & (c("position") <= 5), (c("label") == "A") & (c("position") <= 2))


@query("PF12_keyword_class", """SELECT doc_id, CASE WHEN lang = 'fr' THEN 'KNOWN' WHEN n_chars <= 5000 AND (contains(lower(text), 'license') OR contains(lower(text), 'copyright')) THEN 'LEGAL' WHEN n_chars <= 5000 AND contains(lower(text), 'token') THEN 'SECRET' ELSE 'OTHER' END AS class FROM documents""")
def pf12(s, d):
    k = C.keyword_class(c("text"), c("n_chars"), {"LEGAL": ["license", "copyright"], "SECRET": ["token"]}, 5000, c("lang") == "fr", "KNOWN")
    return table(s, d, "documents").select("doc_id", k.alias("class"))


@query("PF13_validate_records", """SELECT c_custkey, regexp_matches(c_name, '^Customer#[0-9]{9}$') AS name_ok, c_acctbal > 0 AS balance_ok, trim(c_mktsegment) <> '' AS segment_ok, regexp_matches(c_name, '^Customer#[0-9]{9}$') AND c_acctbal > 0 AND trim(c_mktsegment) <> '' AS valid FROM customer""")
def pf13(s, d):
    v = C.validate_records(table(s, d, "customer"), {"name_ok": c("c_name").rlike("^Customer#[0-9]{9}$"), "balance_ok": c("c_acctbal") > 0, "segment_ok": F.trim("c_mktsegment") != ""})
    return v.select("c_custkey", "name_ok", "balance_ok", "segment_ok", "valid")


@query("PF14_audit_status", """SELECT c_custkey, CASE WHEN c_acctbal < -900 THEN 'FAIL' WHEN c_acctbal < 0 OR c_nationkey > 20 THEN 'REVIEW_NEEDED' ELSE 'PASS' END AS status, array_to_string(list_filter([CASE WHEN c_acctbal < 0 THEN 'NEGATIVE' END, CASE WHEN c_nationkey > 20 THEN 'LATE_KEY' END], lambda x: x IS NOT NULL), ';') AS reasons FROM customer""")
def pf14(s, d):
    status, reasons = C.audit_status(c("c_acctbal") < -900, {"NEGATIVE": c("c_acctbal") < 0, "LATE_KEY": c("c_nationkey") > 20})
    return table(s, d, "customer").select("c_custkey", status.alias("status"), reasons.alias("reasons"))


_SETS = """(SELECT l_orderkey AS k, list_sort(list(DISTINCT l_returnflag)) AS f, list_sort(list(DISTINCT CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'R' END)) AS g FROM lineitem GROUP BY 1)"""


@query("PF15_provenance_class", f"""SELECT k, CASE WHEN f = g THEN 'SAME' WHEN list_has_all(f, g) OR list_has_all(g, f) THEN 'DIFFERENT_EXPLAINED' ELSE 'REVIEW_NEEDED' END AS class FROM {_SETS}""")
def pf15(s, d):
    g = table(s, d, "lineitem").groupBy(c("l_orderkey").alias("k")).agg(F.collect_set("l_returnflag").alias("f"), F.collect_set(F.when(c("l_linestatus") == "O", "N").otherwise("R")).alias("g"))
    return g.select("k", C.provenance_class(c("f"), c("g")).alias("class"))


@query("PF16_scope_class", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount = 0 THEN 'PLACEHOLDER' WHEN l_quantity < 5 THEN 'TOO_SMALL' WHEN l_returnflag = 'R' THEN 'RETURNED' ELSE 'IN_SCOPE' END AS scope FROM lineitem""")
def pf16(s, d):
    rules = [("PLACEHOLDER", c("l_discount") == 0), ("TOO_SMALL", c("l_quantity") < 5), ("RETURNED", c("l_returnflag") == "R")]
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", C.scope_class(rules).alias("scope"))


@query("PF17_tolerance_status", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount = 0 THEN 'REVIEW_NEEDED' WHEN abs(l_tax - l_discount) <= 0.0001 THEN 'MATCH' WHEN abs(l_tax - l_discount) <= 0.015 THEN 'MINOR' ELSE 'REVIEW_NEEDED' END AS status FROM lineitem""")
def pf17(s, d):
    b = F.when(c("l_discount") != 0, c("l_discount"))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", C.tolerance_status(c("l_tax"), b, 1e-4, 0.015).alias("status"))


@query("PF18_boundary_diff_class", """SELECT k, b, e, CASE WHEN e % 10 = 0 THEN 'UNAVAILABLE' WHEN greatest(abs(b - 100), abs(e - 120)) = 0 THEN 'MATCH' WHEN greatest(abs(b - 100), abs(e - 120)) <= 20 THEN 'MINOR' ELSE 'MATERIAL' END AS class FROM ivals""")
def pf18(s, d):
    e = F.when(c("e") % 10 != 0, c("e"))
    return ivals(s, d).select("k", "b", "e", C.boundary_diff_class(c("b"), e, F.lit(100), F.lit(120), 20).alias("class"))


@query("PF19_attrition_cause", """SELECT k, b, e, CASE WHEN abs((b % 17) - (e % 13)) <= greatest(1.0, 0.2 * (e - b + 1)) THEN 'BOTH' WHEN b % 17 > e % 13 THEN 'CONSTRUCT_GAP' ELSE 'COORDINATE_GAP' END AS cause FROM ivals""")
def pf19(s, d):
    return ivals(s, d).select("k", "b", "e", C.attrition_cause(c("b") % 17, c("e") % 13, c("e") - c("b") + 1).alias("cause"))


@query("PF20_definition_tier", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_type = 'ECONOMY' THEN 'A' WHEN p_size % 2 = 0 OR p_type IN ('ECONOMY', 'STANDARD') THEN 'B' ELSE 'C' END AS tier FROM part""")
def pf20(s, d):
    level = F.when(c("p_size") % 2 == 0, "RESIDUE").otherwise("SEGMENT")
    conf = F.when(c("p_type") == "ECONOMY", "HIGH").when(c("p_type") == "STANDARD", "MODERATE").otherwise("LOW")
    return table(s, d, "part").select("p_partkey", C.definition_tier(level, conf).alias("tier"))


@query("PF21_segment_category", """SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' THEN 'FIRST' WHEN starts_with(p_brand, 'Brand#1') THEN 'TEENS' WHEN starts_with(p_brand, 'Brand#2') THEN 'TWENTIES' ELSE 'OTHER' END AS category FROM part""")
def pf21(s, d):
    return table(s, d, "part").select("p_partkey", C.segment_category(c("p_brand"), {"Brand#1": "FIRST"}, {"Brand#1": "TEENS", "Brand#2": "TWENTIES"}, "OTHER").alias("category"))


@query("PF22_method_flags", """SELECT k, list_contains(flags, 'A') AS "has_A", list_contains(flags, 'R') AS "has_R", len(list_filter(flags, lambda x: x NOT IN ('A', 'R'))) > 0 AS has_other FROM arrs""")
def pf22(s, d):
    return arrs(s, d).select("k", *(e.alias(n) for n, e in C.method_flags(c("flags"), ["A", "R"]).items()))


@query("PF23_mapping_status", """SELECT k, CASE WHEN list_contains(flags, 'N') AND len(flags) = 1 THEN 'CONFIRMED' WHEN list_contains(flags, 'N') THEN 'CONFIRMED_MULTI' ELSE 'REVIEW' END AS status FROM arrs""")
def pf23(s, d):
    return arrs(s, d).select("k", C.mapping_status(F.lit("N"), c("flags")).alias("status"))


@query("PF24_within_reference", """SELECT k, b, e, CASE WHEN k % 7 = 0 THEN 'UNKNOWN' WHEN b >= 50 AND e <= 250 THEN 'WITHIN' ELSE 'EXTENDS_OUTSIDE' END AS status FROM ivals""")
def pf24(s, d):
    return ivals(s, d).select("k", "b", "e", C.within_reference(c("b"), c("e"), F.when(c("k") % 7 != 0, 50), F.lit(250)).alias("status"))
