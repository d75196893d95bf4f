"""Queries of the join and source operators."""

import uuid

from pyspark.sql import functions as F

from tierstats.operators import contracts as Q
from tierstats.operators import joins as J
from tierstats.sources import tables as T
from tierstats.sources.shared import shared_dir
from tierstats.sources.fixtures import feat, ivals, lines, obs, prof, pts, rec, segment_of, table, unitseg

from .q_stats import _RUN, two_runs
from .registry import query

c = F.col
R6 = lambda *cols: [F.round(x, 6).alias(x) for x in cols]


@query("IO2_scan_parquet", """SELECT o_orderkey, o_totalprice FROM orders""")
def io2(s, d):
    return T.scan_parquet(s, f"{d}/orders.parquet", ["o_orderkey", "o_totalprice"])


def _csv(s, d):
    """customer as CSV files, with a blank for each name of a customer without credit, written once for each run."""
    path = f"{shared_dir(s)}/customers-{uuid.uuid4().hex}"
    t = table(s, d, "customer").select(c("c_custkey").cast("string").alias("id"), F.when(c("c_acctbal") > 0, c("c_name")).alias("name"), "c_acctbal")
    T.write_table(t, path, "csv")
    return path


_CSV = "id string, name string, c_acctbal double"


@query("IO1_scan_csv", """SELECT c_custkey::VARCHAR AS id, CASE WHEN c_acctbal > 0 THEN c_name END AS name, coalesce(CASE WHEN c_acctbal > 0 THEN c_name END, '') AS name_or_blank, c_acctbal FROM customer""")
def io1(s, d):
    path = _csv(s, d)
    blank = T.scan_csv(s, path, _CSV, blank_as_null=False).select("id", c("name").alias("name_or_blank"))
    return T.scan_csv(s, path, _CSV).join(blank, "id").select("id", "name", "name_or_blank", "c_acctbal")


@query("IO5_write_table", """SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders""")
def io5(s, d):
    """Two appended batches, partitioned by priority, read back."""
    path, o = f"{shared_dir(s)}/orders-{uuid.uuid4().hex}", table(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    for batch in (c("o_totalprice") < 100000, c("o_totalprice") >= 100000):
        T.write_table(o.where(batch), path, mode="append", partition_by=["o_orderpriority"])
    return s.read.parquet(path)


@query("IO3_flatten_batches", """SELECT user_id, max_by(json_extract(props, '$.k')::INT, event_id) AS k FROM events WHERE event_type <> 'error' GROUP BY user_id""")
def io3(s, d):
    return T.flatten_batches(table(s, d, "events"), "props", "k int", c("event_id"), c("event_type") != "error", "user_id")


@query("IO4_missing_ids", """SELECT id, CASE WHEN id IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48) THEN 'RETURNED' ELSE 'REVIEW_NEEDED' END AS status FROM (SELECT p_partkey AS id FROM part)""")
def io4(s, d):
    got = table(s, d, "lineitem").where("l_quantity > 48").select(c("l_partkey").alias("id"))
    return T.missing_ids(table(s, d, "part").select(c("p_partkey").alias("id")), got, "id")


@query("IO6_fingerprint_table", """SELECT count(*) AS n_rows, sum(('0x' || substr(md5(l_orderkey || '|' || l_partkey || '|' || l_returnflag), 1, 7))::BIGINT)::BIGINT AS hash, count(*) - count(l_orderkey) AS null_l_orderkey, count(*) - count(l_partkey) AS null_l_partkey, count(*) - count(l_returnflag) AS null_l_returnflag FROM lineitem""")
def io6(s, d):
    return Q.fingerprint_table(table(s, d, "lineitem"), ["l_orderkey", "l_partkey", "l_returnflag"], portable=True)


def _registry(s, d):
    line, o = table(s, d, "lineitem"), table(s, d, "orders")
    return T.metrics_registry([("volume", "n_lines", line, F.count("*"), "lineitem"), ("volume", "n_orders", o, F.count("*"), "orders"), ("value", "max_quantity", line, F.max("l_quantity"), "lineitem")])


_REG = """SELECT 'volume' AS category, 'n_lines' AS metric, count(*)::DOUBLE AS value, 'lineitem' AS source FROM lineitem UNION ALL SELECT 'volume', 'n_orders', count(*), 'orders' FROM orders UNION ALL SELECT 'value', 'max_quantity', max(l_quantity), 'lineitem' FROM lineitem"""


@query("IO6b_file_manifest")
def io6b(s, d):
    """Every Parquet file of the tables with its size and hash."""
    return T.file_manifest(s, d, "*.parquet")


@query("IO7_metrics_registry", _REG)
def io7(s, d):
    return _registry(s, d)


@query("IO8_check_claims", f"""SELECT metric, expected, value, CASE WHEN value IS NULL THEN 'NOT_COMPUTED' WHEN abs(value - expected) <= 1e-9 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT * FROM (VALUES ('max_quantity', 50.0::DOUBLE), ('n_orders', 1.0), ('n_units', 25.0)) t(metric, expected)) LEFT JOIN (SELECT metric, value FROM ({_REG})) USING (metric)""")
def io8(s, d):
    return T.check_claims(_registry(s, d), {"max_quantity": 50, "n_orders": 1, "n_units": 25})


@query("JN1_build_inventory", """SELECT o_orderkey, c_custkey IS NOT NULL AS has_first, n IS NOT NULL AS has_second, n FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey""")
def jn1(s, d):
    cust = table(s, d, "customer").where("c_acctbal > 0").select(c("c_custkey").alias("o_custkey"))
    lines = table(s, d, "lineitem").where("l_returnflag = 'R'").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return J.build_inventory(table(s, d, "orders"), cust, ["o_custkey"], lines, ["o_orderkey"]).select("o_orderkey", "has_first", "has_second", "n")


@query("JN2_join_m1", """SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def jn2(s, d):
    cust = table(s, d, "customer").select(c("c_custkey").alias("o_custkey"), "c_name")
    return J.join_m1(table(s, d, "orders"), cust, ["o_custkey"]).select("o_orderkey", "c_name")


@query("JN3_members", """SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)""")
def jn3(s, d):
    ids = table(s, d, "part").where("p_size = 7").select(c("p_partkey").alias("l_partkey"))
    return J.members(table(s, d, "lineitem"), ids, "l_partkey").select("l_orderkey", "l_partkey")


@query("JN4_scope_difference", """SELECT coalesce(a.u, b.u) AS u, count(a.i + b.i) AS n_matched, count(*) FILTER (b.i IS NULL) AS n_missing, count(*) FILTER (a.i IS NULL) AS n_outside FROM (SELECT DISTINCT l_suppkey AS u, l_partkey AS i FROM lineitem WHERE l_returnflag = 'A') a FULL JOIN (SELECT DISTINCT l_suppkey AS u, l_partkey AS i FROM lineitem WHERE l_returnflag = 'N') b ON a.u = b.u AND a.i = b.i GROUP BY 1""")
def jn4(s, d):
    line = table(s, d, "lineitem").select(c("l_suppkey").alias("u"), c("l_partkey").alias("i"), "l_returnflag")
    return J.scope_difference(line.where("l_returnflag = 'A'"), line.where("l_returnflag = 'N'"), "u", "i")


@query("JN5_dense_grid", """SELECT n_nationkey AS unit, p AS position, count(o.entry) AS n FROM nation CROSS JOIN (SELECT unnest(range(1, 51)) AS p) LEFT JOIN obs o ON o.unit = n_nationkey AND o.position = p GROUP BY ALL""")
def jn5(s, d):
    return J.grid_join(table(s, d, "nation").select(c("n_nationkey").alias("unit")), ["unit"], F.lit(1), F.lit(50), obs(s, d))


_REGIONS = """(SELECT l_orderkey AS k, l_partkey % 50 AS qb, l_partkey % 50 + l_quantity::BIGINT % 5 AS qe, l_suppkey % 60 AS tb, l_suppkey % 60 + l_quantity::BIGINT % 5 + CASE WHEN l_discount = 0.1 THEN 1 ELSE 0 END AS te FROM lineitem)"""


@query("JN6_coordinate_map", f"""WITH r AS {_REGIONS}, p AS (SELECT DISTINCT k, qb + i AS q, tb + i AS t FROM r, generate_series(0, qe - qb) AS g(i) WHERE qe - qb = te - tb), bad AS (SELECT k FROM r WHERE qe - qb <> te - tb UNION SELECT k FROM p GROUP BY k, q HAVING count(*) > 1) SELECT k, q, t FROM p WHERE k NOT IN (SELECT k FROM bad)""")
def jn6(s, d):
    n = c("l_quantity").cast("long") % 5
    line = table(s, d, "lineitem")
    qb, tb = c("l_partkey") % 50, c("l_suppkey") % 60
    r = line.select(c("l_orderkey").alias("k"), qb.alias("qb"), (qb + n).alias("qe"), tb.alias("tb"), (tb + n + F.when(c("l_discount") == 0.1, 1).otherwise(0)).alias("te"))
    return J.coordinate_map(r, "k")


_NAMED = "(SELECT k, b, e, CASE WHEN e = b THEN 'HELIX' WHEN e - b < 4 THEN 'SHEET' ELSE 'TURN' END AS l FROM ivals)"


@query("JN7_interval_label_join", f"""SELECT p.k, p.p, coalesce(['HELIX', 'SHEET', 'TURN'][min(CASE l WHEN 'HELIX' THEN 1 WHEN 'SHEET' THEN 2 WHEN 'TURN' THEN 3 END)], 'COIL') AS label FROM (SELECT DISTINCT k, b AS p FROM ivals) p LEFT JOIN {_NAMED} r ON r.k = p.k AND p.p BETWEEN r.b AND r.e GROUP BY p.k, p.p""")
def jn7(s, d):
    i = ivals(s, d)
    r = i.withColumn("l", F.when(c("e") == c("b"), "HELIX").when(c("e") - c("b") < 4, "SHEET").otherwise("TURN"))
    return J.interval_label_join(i.select("k", c("b").alias("p")).distinct(), r, ["k"], "p", "b", "e", "l", ["HELIX", "SHEET", "TURN"], "COIL")


_COVERED = """(SELECT k, count(*) FILTER (p BETWEEN 60 AND 200) AS overlap, count(*) AS total FROM (SELECT DISTINCT k, unnest(range(b, e + 1)) AS p FROM lines) GROUP BY k)"""


@query("JN8_intersect_reference", f"""SELECT k, overlap, round(overlap / 141, 6) AS coverage, overlap = 141 AS full_span, total - overlap AS outside FROM {_COVERED}""")
def jn8(s, d):
    return J.intersect_reference(lines(s, d), ["k"], "b", "e", 60, 200).select("k", "overlap", *R6("coverage"), "full_span", "outside")


@query("JN9_overlap_fraction", """WITH a AS (SELECT DISTINCT k, unnest(range(b, e + 1)) AS p FROM lines WHERE flag = 'N'), z AS (SELECT DISTINCT k, unnest(range(b, e + 1)) AS p FROM lines WHERE flag <> 'N'), n AS (SELECT k, count(*) AS len_a FROM a GROUP BY k), m AS (SELECT k, count(*) AS len_b FROM z GROUP BY k), o AS (SELECT k, count(*) AS overlap FROM a JOIN z USING (k, p) GROUP BY k)
SELECT k, len_a, len_b, coalesce(overlap, 0) AS overlap, CASE WHEN coalesce(overlap, 0) / least(len_a, len_b) <= 0.05 THEN 'DISJOINT' WHEN coalesce(overlap, 0) / least(len_a, len_b) >= 0.8 THEN 'SAME' ELSE 'AMBIGUOUS' END AS relation FROM n JOIN m USING (k) LEFT JOIN o USING (k)""")
def jn9(s, d):
    i = lines(s, d)
    return J.overlap_fraction(i.where("flag = 'N'"), i.where("flag <> 'N'")).drop("fraction")


@query("JN9b_one_partner", """WITH a AS (SELECT DISTINCT k, unnest(range(b, e + 1)) AS p FROM lines WHERE flag = 'N'), p AS (SELECT k, count(DISTINCT flag) AS n FROM lines WHERE flag <> 'N' GROUP BY k), z AS (SELECT DISTINCT k, unnest(range(b, e + 1)) AS p FROM lines WHERE flag <> 'N'),
la AS (SELECT k, count(*) AS len_a FROM a GROUP BY k), lb AS (SELECT k, count(*) AS len_b FROM z GROUP BY k), o AS (SELECT k, count(*) AS overlap FROM a JOIN z USING (k, p) GROUP BY k)
SELECT k, coalesce(n, 0) AS n_partners, CASE WHEN n = 1 THEN coalesce(overlap, 0) END AS overlap, CASE WHEN n = 1 AND coalesce(overlap, 0) / least(len_a, len_b) <= 0.05 THEN 'DISJOINT' WHEN n = 1 AND coalesce(overlap, 0) / least(len_a, len_b) >= 0.8 THEN 'SAME' ELSE 'AMBIGUOUS' END AS relation FROM la LEFT JOIN p USING (k) LEFT JOIN lb USING (k) LEFT JOIN o USING (k)""")
def jn9b(s, d):
    i = lines(s, d)
    return J.overlap_fraction(i.where("flag = 'N'"), i.where("flag <> 'N'"), partner="flag").select("k", "n_partners", "overlap", "relation")


@query("JN10_boundary_sensitivity", """WITH p AS (SELECT DISTINCT k, unnest(range(b, e + 1)) AS p FROM lines) SELECT k, round(count(*) FILTER (p BETWEEN 50 AND 149) / 100, 6) AS coverage_a, round(count(*) FILTER (p BETWEEN 80 AND 179) / 100, 6) AS coverage_b, (count(*) FILTER (p BETWEEN 50 AND 149) / 100 >= 0.3) <> (count(*) FILTER (p BETWEEN 80 AND 179) / 100 >= 0.3) AS changed FROM p GROUP BY k""")
def jn10(s, d):
    g = J.boundary_sensitivity(lines(s, d), ["k"], "b", "e", (50, 149), (80, 179), 0.3)
    return g.select("k", *R6("coverage_a", "coverage_b"), "changed")


@query("JN11_radius_contacts", """SELECT a.label, b.vec_id AS probe, a.vec_id AS point, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) AS distance FROM pts a JOIN pts b ON a.label = b.label WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 5.0""")
def jn11(s, d):
    p = pts(s, d)
    return J.radius_contacts(p, p, "label", "vec_id", "vec_id", 5.0).withColumn("distance", F.round("distance", 6))


_ATOMS = "(SELECT label, vec_id % 100 AS position, vec_id // 20 AS probe, embedding[4] AS occ_point, embedding[5] AS occ_probe, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y, embedding[3]::DOUBLE * 100 AS z FROM embeddings)"


def contact_atoms(s, d):
    """Vectors as atoms, with two more components as occupancies, some of them 0 or less; a probe has up to 20 atoms."""
    at = lambda i: c("embedding")[i].cast("double") * 100
    return table(s, d, "embeddings").select("label", (c("vec_id") % 100).alias("position"), F.floor(c("vec_id") / 20).alias("probe"), c("embedding")[3].alias("occ_point"), c("embedding")[4].alias("occ_probe"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


def _probes_sql(inventory: bool) -> str:
    return f"""(WITH t AS {_ATOMS}, a AS (SELECT *, max(occ_probe) OVER (PARTITION BY label, probe) > 0 AS has FROM t), q AS (SELECT * FROM a WHERE occ_probe > 0{' OR NOT has' if inventory else ''}), p AS (SELECT * FROM t WHERE occ_point > 0),
  d AS (SELECT q.label, q.probe, p.position, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2) AS d FROM q JOIN p ON p.label = q.label),
  m AS (SELECT label, probe, min(d) AS d, array_to_string(list_sort(list(DISTINCT position) FILTER (d <= 4.5)), ',') AS positions FROM d GROUP BY ALL)
  SELECT q.label, q.probe, count(*) AS n_atoms, round(any_value(m.d), 6) AS min_distance, coalesce(any_value(m.d) <= 4.5, false) AS within_near, coalesce(any_value(m.d) <= 5.0, false) AS within_far, coalesce(any_value(positions), '') AS positions FROM q LEFT JOIN m ON m.label = q.label AND m.probe = q.probe GROUP BY q.label, q.probe)"""


@query("JN11b_probe_contacts", f"""SELECT 'inventory' AS form, * FROM {_probes_sql(True)} UNION ALL SELECT 'pocket', * FROM {_probes_sql(False)}""")
def jn11b(s, d):
    t = contact_atoms(s, d)
    form = lambda name, inventory: J.probe_contacts(t.withColumnRenamed("occ_point", "occ"), t.withColumnRenamed("occ_probe", "occ"), "label", "position", "probe", "occ", inventory=inventory).select(F.lit(name).alias("form"), "*")
    both = form("inventory", True).unionByName(form("pocket", False))
    return both.withColumns({"min_distance": F.round("min_distance", 6), "positions": F.concat_ws(",", "positions")})


@query("JN12_nearest_within", """SELECT i.k, i.b, min({'d': abs(s - b), 's': s}).s AS nearest FROM (SELECT DISTINCT k, b FROM lines) i LEFT JOIN (SELECT DISTINCT k, e AS s FROM lines WHERE flag = 'R') x ON x.k = i.k AND abs(s - b) <= 30 GROUP BY i.k, i.b""")
def jn12(s, d):
    i = lines(s, d)
    sites = i.where("flag = 'R'").select("k", c("e").alias("s")).distinct()
    return J.nearest_within(i.select("k", "b").distinct(), sites, ["k"], "b", "s", 30).select("k", "b", "nearest")


_CALLS = """(SELECT instance, position, CASE WHEN value > 85000 THEN 'H' || position::VARCHAR END AS call FROM obs)"""


@query("JN13_bracketing_neighbours", f"""SELECT instance, position, CASE WHEN call IS NOT NULL THEN call WHEN b IS NOT NULL AND a IS NOT NULL THEN 'loop_' || b || '_' || a ELSE 'LOOP_UNCERTAIN' END AS name, CASE WHEN call IS NOT NULL OR (b IS NOT NULL AND a IS NOT NULL) THEN '' WHEN a IS NOT NULL THEN 'NO_CALL_BEFORE' WHEN b IS NOT NULL THEN 'NO_CALL_AFTER' ELSE 'NO_CALLS' END AS reason FROM (SELECT *, last_value(call IGNORE NULLS) OVER (PARTITION BY instance ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(call IGNORE NULLS) OVER (PARTITION BY instance ORDER BY position ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM {_CALLS})""")
def jn13(s, d):
    g = obs(s, d).select("instance", "position", F.when(c("value") > 85000, F.concat(F.lit("H"), c("position").cast("string"))).alias("call"))
    return J.bracketing_neighbours(g, ["instance"], "position", "call").select("instance", "position", "name", "reason")


@query("JN14_unit_site_availability", """WITH g AS (SELECT n_nationkey AS unit, site FROM nation, (SELECT unnest(['A', 'N', 'R']) AS site)), n AS (SELECT unit, label AS site, count(*) AS n FROM rec WHERE quantity > 48 AND position < 9 GROUP BY ALL) SELECT unit, site, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'UNRESOLVED' WHEN n >= 5 THEN 'AVAILABLE' ELSE 'PARTIAL' END AS status FROM g LEFT JOIN n USING (unit, site)""")
def jn14(s, d):
    defs = rec(s, d).where("quantity > 48 AND position < 9").select("unit", c("label").alias("site"), F.lit("HIGH").alias("confidence"))
    return J.unit_site_availability(table(s, d, "nation").select(c("n_nationkey").alias("unit")), "unit", ["A", "N", "R"], defs, 5).select("unit", "site", "n", "status")


@query("JN15_eligibility_grid", """SELECT segment, grp, n_total, coalesce(n, 0) AS n_observed, n_total - coalesce(n, 0) AS n_missing, coalesce(n, 0) >= 3 AS eligible FROM (SELECT DISTINCT segment FROM unitseg) CROSS JOIN (SELECT n_regionkey AS grp, count(*) AS n_total FROM nation GROUP BY 1) LEFT JOIN (SELECT segment, grp, count(DISTINCT unit) AS n FROM unitseg WHERE n_entries >= 59 GROUP BY ALL) USING (segment, grp)""")
def jn15(s, d):
    units = table(s, d, "nation").select(c("n_nationkey").alias("unit"), c("n_regionkey").alias("grp"))
    seen = unitseg(s, d).where("n_entries >= 59").unionByName(unitseg(s, d).where("false"))
    g = J.eligibility_grid(seen, units, "unit", "grp", "segment")
    names = table(s, d, "part").select(segment_of(c("p_size")).alias("segment")).distinct()
    full = names.join(F.broadcast(units.groupBy("grp").agg(F.count("*").alias("t"))))
    return full.join(g, ["segment", "grp"], "left").select("segment", "grp", c("t").alias("n_total"), F.coalesce("n_observed", F.lit(0)).alias("n_observed"), F.coalesce("n_missing", "t").alias("n_missing"), F.coalesce("eligible", F.lit(False)).alias("eligible"))


@query("JN16_set_overlap", """WITH p AS (SELECT DISTINCT unit, 'S' || ((position - 1) // 10)::VARCHAR AS segment, position FROM obs WHERE value > 90000), q AS (SELECT DISTINCT unit, 'T' || (position % 3)::VARCHAR AS site, position FROM obs WHERE value < 2000), n AS (SELECT unit, segment, count(*) AS n_positions FROM p GROUP BY ALL), h AS (SELECT unit, segment, site, count(*) AS n_overlap FROM p JOIN q USING (unit, position) GROUP BY ALL)
SELECT unit, segment, site, n_positions, coalesce(n_overlap, 0) AS n_overlap, round(coalesce(n_overlap, 0) / n_positions, 6) AS fraction FROM n LEFT JOIN h USING (unit, segment)""")
def jn16(s, d):
    o = obs(s, d)
    p = o.where("value > 90000").select("unit", segment_of(c("position")).alias("segment"), "position").distinct()
    q = o.where("value < 2000").select("unit", F.concat(F.lit("T"), (c("position") % 3).cast("string")).alias("site"), "position").distinct()
    return J.set_overlap(p, q, "unit", "segment", "site", "position").withColumn("fraction", F.round("fraction", 6))


@query("JN17_pair_identity", """WITH q AS (SELECT unit, position, min(label) AS sym FROM rec WHERE quantity > 45 GROUP BY ALL) SELECT a.unit AS u1, b.unit AS u2, count(*) AS n_shared, round(avg((a.sym = b.sym)::INT), 6) AS identity FROM q a JOIN q b ON a.position = b.position AND a.unit < b.unit GROUP BY ALL""")
def jn17(s, d):
    q = rec(s, d).where("quantity > 45").groupBy("unit", "position").agg(F.min("label").alias("sym"))
    return J.pair_identity(q, "unit", "position", "sym").withColumn("identity", F.round("identity", 6))


@query("JN17b_identity_summary", """WITH q AS (SELECT unit, position, min(label) AS sym FROM rec WHERE quantity > 45 AND position BETWEEN unit * 2 - 12 AND unit * 2 + 16 GROUP BY ALL), r AS (SELECT unit, min(position) AS lo, max(position) AS hi FROM q GROUP BY unit), i AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY position) - 1 AS idx FROM q),
p AS (SELECT avg((a.sym = b.sym)::INT) AS m FROM q a JOIN q b ON a.position = b.position AND a.unit < b.unit GROUP BY a.unit, b.unit), x AS (SELECT avg((a.sym = b.sym)::INT) AS m FROM i a JOIN i b ON a.idx = b.idx AND a.unit < b.unit GROUP BY a.unit, b.unit), n AS (SELECT count(*)::DOUBLE AS n FROM q GROUP BY sym)
SELECT (SELECT count(*) FROM r) AS n_units, (SELECT count(*) FROM r a JOIN r b ON a.unit < b.unit) AS n_pairs, (SELECT count(*) FROM r a JOIN r b ON a.unit < b.unit WHERE a.hi < b.lo OR b.hi < a.lo) AS n_disjoint, (SELECT count(*) FROM p) AS n_sharing,
(SELECT round(avg(m), 6) FROM p) AS identity_position, (SELECT round(avg(m), 6) FROM x) AS identity_relative, (SELECT round(sum(n * n) / sum(n) ** 2, 6) FROM n) AS chance""")
def jn17b(s, d):
    """Units see windows of positions that move along, so that some pairs share none."""
    seen = c("position").between(c("unit") * 2 - 12, c("unit") * 2 + 16)
    q = rec(s, d).where((c("quantity") > 45) & seen).groupBy("unit", "position").agg(F.min("label").alias("sym"))
    return J.identity_summary(q, "unit", "position", "sym").select("n_units", "n_pairs", "n_disjoint", "n_sharing", *R6("identity_position", "identity_relative", "chance"))


@query("JN18_crosscheck", """WITH l AS (SELECT DISTINCT instance, position FROM rec WHERE quantity = 1) SELECT o.instance, o.position, CASE WHEN l.instance IS NOT NULL AND value IS NOT NULL THEN 'LISTED_BUT_POSITIVE' WHEN l.instance IS NOT NULL THEN 'LISTED_BUT_ZERO' END AS category FROM obs o LEFT JOIN l ON l.instance = o.instance AND l.position = o.position WHERE l.instance IS NOT NULL""")
def jn18(s, d):
    g = J.crosscheck(obs(s, d), rec(s, d).where("quantity = 1"), ["instance", "position"], c("n_records") > 0, c("value").isNotNull())
    return g.select("instance", "position", "category")


@query("JN18b_residual_audit", """WITH g AS (SELECT instance, p AS position FROM (SELECT DISTINCT instance FROM obs), (SELECT unnest(range(1, 51)) AS p)), l AS (SELECT DISTINCT instance, position FROM rec WHERE quantity = 1), j AS (SELECT g.instance, g.position, n_records IS NOT NULL AS present, value IS NOT NULL AS positive FROM g ANTI JOIN l USING (instance, position) LEFT JOIN obs o ON o.instance = g.instance AND o.position = g.position),
r AS (SELECT instance, CASE WHEN NOT present THEN 'NO_RECORD' ELSE 'ZERO_ONLY' END AS kind, concat_ws('; ', CASE WHEN position NOT BETWEEN 6 AND 45 THEN 'outside the range' END, CASE WHEN position % 10 = 0 THEN 'end of a segment' END) AS reason FROM j WHERE NOT positive)
SELECT instance, count(*) FILTER (kind = 'NO_RECORD') AS n_no_record, count(*) FILTER (kind = 'ZERO_ONLY') AS n_zero_only, count(*) FILTER (reason = '') AS n_explained, count(*) FILTER (reason = 'outside the range; end of a segment') AS n_both FROM r GROUP BY instance""")
def jn18b(s, d):
    """Every instance with all positions; two conditions on the position."""
    o = obs(s, d).select("instance", "position", "n_records", "value")
    g = o.select("instance").distinct().withColumn("position", F.explode(F.sequence(F.lit(1), F.lit(50))))
    g = g.join(o.hint("merge"), ["instance", "position"], "left")
    want = {"outside the range": c("position").between(6, 45), "end of a segment": c("position") % 10 != 0}
    a = J.residual_audit(g, rec(s, d).where("quantity = 1"), ["instance", "position"], c("n_records").isNotNull(), c("value").isNotNull(), want)
    return a.groupBy("instance").agg(
        F.count_if(c("case") == "NO_RECORD").alias("n_no_record"), F.count_if(c("case") == "ZERO_ONLY").alias("n_zero_only"), F.count_if(c("status") == "EXPLAINED").alias("n_explained"),
        F.count_if(c("reason") == "outside the range; end of a segment").alias("n_both"),
    )


@query("JN19_compare_runs", f"""SELECT a.unit, a.segment, sign(a.eff) = sign(b.eff) AS same_direction, CASE WHEN a.p < 0.05 AND b.p < 0.05 THEN 'PRESERVED' WHEN a.p < 0.05 THEN 'LOST' WHEN b.p < 0.05 THEN 'GAINED' ELSE 'NEITHER' END AS significance FROM {_RUN['v']} a JOIN {_RUN['mean_v']} b USING (unit, segment)""")
def jn19(s, d):
    return J.compare_runs(*two_runs(s, d), ["unit", "segment"], "eff", "p").select("unit", "segment", "same_direction", "significance")


@query("JN20_master_table", """SELECT c_custkey, n, o IS NOT NULL AS has_orders, n IS NOT NULL AS has_profile, o FROM customer LEFT JOIN (SELECT entry, count(*) AS n FROM prof GROUP BY entry) ON entry = c_custkey LEFT JOIN (SELECT o_custkey, count(*) AS o FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def jn20(s, d):
    parts = {"profile": prof(s, d).groupBy(c("entry").alias("c_custkey")).agg(F.count("*").alias("n")), "orders": table(s, d, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.count("*").alias("o"))}
    return J.master_table(table(s, d, "customer"), "c_custkey", parts).select("c_custkey", "n", "has_orders", "has_profile", "o")


@query("JN21_unique_or_blank", """SELECT o_orderkey, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN v END AS flag, CASE WHEN n > 1 THEN 'SEVERAL_ROWS' ELSE '' END AS note FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_returnflag) AS v FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def jn21(s, d):
    line = table(s, d, "lineitem").select(c("l_orderkey").alias("o_orderkey"), c("l_returnflag").alias("flag"))
    return J.unique_or_blank(line, table(s, d, "orders").select("o_orderkey"), "o_orderkey", "flag")


@query("JN22_refresh_columns", """SELECT c_custkey, CASE WHEN c_nationkey < 10 THEN c_acctbal * 2 END AS c_acctbal FROM customer""")
def jn22(s, d):
    cust = table(s, d, "customer")
    new = cust.where("c_nationkey < 10").select("c_custkey", (c("c_acctbal") * 2).alias("c_acctbal"))
    return J.refresh_columns(cust, "c_custkey", new, ["c_acctbal"]).select("c_custkey", "c_acctbal")


@query("JN23_instance_inventory", """SELECT o_orderkey, flag AS instance, CASE WHEN flag IS NULL THEN 'REVIEW_NEEDED' ELSE 'LISTED' END AS status FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_returnflag AS flag FROM lineitem) ON l_orderkey = o_orderkey""")
def jn23(s, d):
    g = table(s, d, "lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_returnflag").alias("list"))
    return J.instance_inventory(table(s, d, "orders").select("o_orderkey").join(g, "o_orderkey", "left"), "o_orderkey", "list")


@query("JN24_sequence_symbol", """SELECT p_partkey, CASE substr(upper(p_name), p_size, 1) WHEN 'R' THEN 'ARG' WHEN 'E' THEN 'GLU' WHEN 'D' THEN 'ASP' WHEN 'W' THEN 'TRP' WHEN 'I' THEN 'ILE' WHEN 'G' THEN 'GLY' WHEN 'T' THEN 'THR' WHEN 'N' THEN 'ASN' WHEN 'S' THEN 'SER' WHEN 'M' THEN 'MET' WHEN 'A' THEN 'ALA' WHEN 'L' THEN 'LEU' WHEN 'C' THEN 'CYS' WHEN 'Q' THEN 'GLN' WHEN 'H' THEN 'HIS' WHEN 'K' THEN 'LYS' WHEN 'F' THEN 'PHE' WHEN 'P' THEN 'PRO' WHEN 'Y' THEN 'TYR' WHEN 'V' THEN 'VAL' ELSE '' END AS symbol FROM part""")
def jn24(s, d):
    return table(s, d, "part").select("p_partkey", J.sequence_symbol(F.upper("p_name"), c("p_size")).alias("symbol"))
