"""Queries of the composite layers. Units are nations, sites fixed position sets by the parity of the unit."""

from pyspark.sql import functions as F

from tierstats.operators import aggregate as A
from tierstats.operators import layers as L
from tierstats.operators import stats as S
from tierstats.operators import windows as W
from tierstats.sources import fixtures
from tierstats.sources.fixtures import prof, pts, rec, segment_of, table, unitseg

from . import tails
from .q_joins import _probes_sql, contact_atoms
from .q_stats import _draws, _F, _TESTS_P
from .registry import query

c = F.col
SITES = {"POCKET": (3, 4, 5, 13, 14), "GROOVE": (7, 8, 9)}


def sites(s, d):
    """(unit, site, position): the site's positions, 20 higher for odd units."""
    each = F.array(*(F.struct(F.lit(n).alias("site"), F.lit(p).alias("p")) for n, ps in SITES.items() for p in ps))
    u = table(s, d, "nation").select(c("n_nationkey").alias("unit"), F.explode(each).alias("x"))
    return u.select("unit", "x.site", (c("x.p") + 20 * (c("unit") % 2)).alias("position"))


_SITES = "(SELECT n_nationkey AS unit, site, p + 20 * (n_nationkey % 2) AS position FROM nation, (VALUES " + ", ".join(f"('{n}', {p})" for n, ps in SITES.items() for p in ps) + ") t(site, p))"
_CALLS = """(SELECT unit, position, CASE WHEN n >= a AND n >= r THEN 'HELIX' WHEN a >= r THEN 'SHEET' ELSE 'COIL' END AS state FROM (SELECT unit, position, count(*) FILTER (label = 'N') AS n, count(*) FILTER (label = 'A') AS a, count(*) FILTER (label = 'R') AS r FROM rec GROUP BY ALL))"""
_CRUNS = f"""(SELECT unit, state, min(position) AS s, max(position) AS e FROM (SELECT unit, position, state, position - row_number() OVER (PARTITION BY unit, state ORDER BY position) AS i FROM {_CALLS}) GROUP BY unit, state, i)"""
_BLOCKS = f"""(SELECT unit, CASE WHEN state = 'HELIX' THEN 'H' ELSE 'B' END || s::VARCHAR AS segment, state AS cls, s, e FROM {_CRUNS} WHERE state <> 'COIL' AND e - s >= 2)"""


def calls(s, d):
    g = A.vote_consensus(rec(s, d), ["unit", "position"], "label", ["N", "A", "R"], "entry")
    return g.select("unit", "position", F.when(c("winner") == "N", "HELIX").when(c("winner") == "A", "SHEET").otherwise("COIL").alias("state"))


def call_runs(s, d):
    return W.runs(calls(s, d), ["unit"], "position", "state")


def blocks(s, d):
    r = call_runs(s, d).where("state <> 'COIL' AND length >= 3")
    name = F.concat(F.when(c("state") == "HELIX", "H").otherwise("B"), c("start").cast("string"))
    return r.select("unit", name.alias("segment"), c("state").alias("cls"), "start", "end")


def bounds(s, d):
    return table(s, d, "nation").select(c("n_nationkey").alias("unit"), F.lit(1).alias("lo"), F.lit(50).alias("hi"))


@query("CL1_topology_labels", f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY unit, state ORDER BY s) AS o, count(*) OVER (PARTITION BY unit, state) AS n, min(CASE WHEN state = 'HELIX' THEN s END) OVER (PARTITION BY unit) AS fh, max(CASE WHEN state = 'HELIX' THEN s END) OVER (PARTITION BY unit) AS lh FROM {_CRUNS} WHERE state <> 'COIL')
SELECT unit, state, s AS "start", e AS "end", CASE WHEN state = 'HELIX' AND o = 1 AND s - 1 <= 15 THEN 'H1' WHEN state = 'HELIX' AND o = n AND 50 - e <= 15 THEN 'H9' WHEN state = 'SHEET' AND n = 1 AND fh < s AND lh > s THEN 'beta_sheet' WHEN state = 'HELIX' AND n = 9 THEN 'H' || o::VARCHAR ELSE 'AMBIGUOUS' END AS segment FROM h""")
def cl1(s, d):
    return L.topology_labels(call_runs(s, d), bounds(s, d), "unit", "state", 9).select("unit", "state", "start", "end", "segment")


def _corr(s, d):
    """Each unit against the four next units as templates, position by position."""
    u = table(s, d, "nation").select(c("n_nationkey").alias("unit"), F.explode(F.array(*(F.lit(i) for i in range(1, 5)))).alias("i"))
    u = u.select("unit", ((c("unit") + c("i")) % 25).alias("template"), (F.lit(3.0) + (c("unit") * 7 + c("i") * 3) % 10 / 10).alias("score"))
    return u.withColumn("q", F.explode(F.sequence(F.lit(1), F.lit(50)))).withColumn("t", c("q"))


def _template_labels(s, d):
    b = blocks(s, d).where(c("end") - c("start") >= 4)
    return b.select(c("unit").alias("template"), F.explode(F.sequence("start", "end")).alias("t"), F.concat(F.lit("G"), F.floor(c("start") / 10).cast("string"), c("cls")).alias("segment"), "cls").distinct()


def _targets(s, d):
    return call_runs(s, d).select("unit", c("state").alias("cls"), "start", "end")


_MAP = "(SELECT n_nationkey AS unit, (n_nationkey + i) % 25 AS template, 3.0::DOUBLE + (n_nationkey * 7 + i * 3) % 10 / 10 AS score, q, q AS t FROM nation, (SELECT unnest(range(1, 5)) AS i), (SELECT unnest(range(1, 51)) AS q))"
_OFFER = f"(SELECT DISTINCT unit AS template, unnest(range(s, e + 1)) AS t, 'G' || (s // 10)::VARCHAR || cls AS segment, cls FROM {_BLOCKS} WHERE e - s >= 4)"
_GRID = f"(SELECT unit, state AS cls, s, e, unnest(range(s, e + 1)) AS q FROM {_CRUNS})"


def _placed(usable: float = 3.5) -> str:
    return f"""(WITH hit AS (SELECT * FROM {_MAP} JOIN {_OFFER} USING (template, t) WHERE score >= {usable}), offer AS (SELECT unit, segment, cls, template, max(score) AS score, count(*) AS aligned FROM hit GROUP BY ALL),
 best AS (SELECT * FROM offer QUALIFY row_number() OVER (PARTITION BY unit, segment ORDER BY score DESC, aligned DESC, template) = 1), pos AS (SELECT unit, segment, template, best.cls, q FROM hit JOIN best USING (unit, segment, template)),
 cnt AS (SELECT unit, segment, count(*) AS n FROM pos GROUP BY ALL), over AS (SELECT unit, segment, template, s, e, count(*) AS overlap FROM pos JOIN {_GRID} USING (unit, cls, q) GROUP BY ALL),
 top AS (SELECT * FROM over QUALIFY row_number() OVER (PARTITION BY unit, segment ORDER BY overlap DESC, s) = 1)
 SELECT unit, segment, template, s AS "start", e AS "end", overlap, n, CASE WHEN overlap / n >= 0.5 THEN 'HIGH' WHEN overlap / n >= 0.3 THEN 'MODERATE' ELSE 'LOW' END AS confidence FROM top JOIN cnt USING (unit, segment))"""


_CORE = "['G0HELIX', 'G1HELIX', 'G2HELIX', 'G3HELIX', 'G4HELIX', 'G0SHEET', 'G1SHEET', 'G2SHEET', 'G3SHEET', 'G4SHEET']"


@query("CL2_transfer_labels", f"SELECT * FROM {_placed()}")
def cl2(s, d):
    return L.transfer_labels(_corr(s, d), _template_labels(s, d), _targets(s, d))


@query("CL3_rescue_labels", f"""WITH gap AS (SELECT unit, segment FROM (SELECT DISTINCT unit FROM {_MAP}), (SELECT unnest({_CORE}) AS segment) WHERE (unit, segment) NOT IN (SELECT (unit, segment) FROM {_placed(3.8)})),
ord AS (SELECT unit, template, row_number() OVER (PARTITION BY unit ORDER BY max(score) DESC, template) AS rank FROM {_MAP} GROUP BY unit, template QUALIFY rank <= 10), hit AS (SELECT unit, segment, template, rank, cls, q FROM {_MAP} JOIN {_OFFER} USING (template, t) JOIN gap USING (unit, segment) JOIN ord USING (unit, template)),
size AS (SELECT unit, segment, template, count(*) AS len FROM hit GROUP BY ALL), over AS (SELECT unit, segment, template, rank, s, e, count(*) AS overlap FROM hit JOIN {_GRID} USING (unit, cls, q) GROUP BY ALL)
SELECT unit, segment, template, s AS "start", e AS "end", overlap FROM over JOIN size USING (unit, segment, template) WHERE overlap >= greatest(3, 0.3 * len) QUALIFY row_number() OVER (PARTITION BY unit, segment ORDER BY rank, overlap DESC, s) = 1""")
def cl3(s, d):
    placed = L.transfer_labels(_corr(s, d), _template_labels(s, d), _targets(s, d), usable=3.8)
    return L.rescue_labels(placed, [f"G{i}{k}" for k in ("HELIX", "SHEET") for i in range(5)], _corr(s, d), _template_labels(s, d), _targets(s, d))


@query("CL4_template_from_landmarks")
def cl4(s, d):
    marks = s.createDataFrame([("L1", 5), ("L2", 15), ("L3", 25), ("L4", 35), ("L5", 45)], "segment string, position int")
    g = rec(s, d).where("label = 'N'").groupBy("unit", "entry").agg(F.count("*").alias("n"))
    best = W.top_n(g, ["unit"], [F.desc("n"), c("entry")], 10).select(c("unit"), c("entry"), c("rank").alias("priority"))
    r = W.runs(rec(s, d).join(best, ["unit", "entry"], "left_semi").select("unit", "entry", "position", F.lit("X").alias("state")), ["unit", "entry"], "position", "state")
    r = r.join(best, ["unit", "entry"]).withColumnRenamed("entry", "candidate")
    return L.template_from_landmarks(r, marks, "unit", "candidate")


_RANKED = f"(SELECT *, row_number() OVER (PARTITION BY unit ORDER BY CASE confidence WHEN 'HIGH' THEN 0 WHEN 'MODERATE' THEN 1 WHEN 'LOW' THEN 2 END, o) AS i FROM (SELECT unit, segment, \"start\" AS st, confidence, 3 * substr(segment, 2, 1)::INT + CASE substr(segment, 3) WHEN 'HELIX' THEN 0 WHEN 'SHEET' THEN 1 ELSE 2 END AS o FROM {_placed()}))"
_FITS = "len(list_filter(range(1, len(po) + 1), lambda j: (o - po[j]) * (st - pq[j]) <= 0)) = 0"


@query("CL5_enforce_order", f"""SELECT * FROM (WITH RECURSIVE b AS MATERIALIZED {_RANKED}, k(unit, i, po, pq, kept) AS (SELECT unit, 0::BIGINT, []::BIGINT[], []::BIGINT[], false FROM (SELECT DISTINCT unit FROM b) UNION ALL
SELECT b.unit, b.i, CASE WHEN {_FITS} THEN list_append(po, o) ELSE po END, CASE WHEN {_FITS} THEN list_append(pq, st) ELSE pq END, {_FITS} FROM k JOIN b ON b.unit = k.unit AND b.i = k.i + 1)
SELECT b.unit, segment, st AS "start", confidence, kept FROM b JOIN k ON k.unit = b.unit AND k.i = b.i)""")
def cl5(s, d):
    got = L.transfer_labels(_corr(s, d), _template_labels(s, d), _targets(s, d))
    return L.enforce_order(got, [f"G{i}{k}" for i in range(6) for k in ("HELIX", "SHEET", "COIL")])


@query("CL6_segment_map", f"""WITH g AS (SELECT n_nationkey AS unit, p AS position FROM nation, (SELECT unnest(range(1, 51)) AS p)), d AS (SELECT g.unit, g.position, min(segment) AS call FROM g LEFT JOIN {_BLOCKS} b ON b.unit = g.unit AND g.position BETWEEN b.s AND b.e GROUP BY ALL),
w AS (SELECT *, last_value(call IGNORE NULLS) OVER (PARTITION BY unit ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(call IGNORE NULLS) OVER (PARTITION BY unit ORDER BY position ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM d)
SELECT unit, position, CASE WHEN call IS NOT NULL THEN call WHEN a IS NOT NULL AND b IS NOT NULL THEN 'loop_' || b || '_' || a WHEN a IS NULL AND b IS NULL THEN 'NO_EVIDENCE' ELSE 'LOOP_UNCERTAIN' END AS name FROM w""")
def cl6(s, d):
    return L.segment_map(bounds(s, d), blocks(s, d)).select("unit", "position", "name")


@query("CL7_missing_segment_audit", f"""SELECT unit, segment, CASE WHEN unit NOT IN (SELECT unit FROM {_CRUNS} WHERE state = 'HELIX') THEN 'A_NO_EVIDENCE' WHEN segment NOT IN (SELECT segment FROM {_OFFER}) THEN 'D_NO_TEMPLATE' ELSE 'C_ALIGNMENT_FAILED' END AS cause
FROM (SELECT n_nationkey AS unit FROM nation), (SELECT unnest(list_append({_CORE}, 'G9HELIX')) AS segment) WHERE (unit, segment) NOT IN (SELECT (unit, segment) FROM {_placed()})""")
def cl7(s, d):
    placed = L.transfer_labels(_corr(s, d), _template_labels(s, d), _targets(s, d))
    return L.missing_segment_audit(bounds(s, d), [*(f"G{i}{k}" for k in ("HELIX", "SHEET") for i in range(5)), "G9HELIX"], placed, _template_labels(s, d), call_runs(s, d).where("state = 'HELIX'"))


@query("CL8_segment_validation", f"""SELECT b.unit, segment, s AS "start", e AS "end", e - s + 1 AS length, count(k.state) AS n_called, round(avg((coalesce(k.state, '') = cls)::INT), 6) AS agreement FROM {_BLOCKS} b JOIN {_CALLS} k ON k.unit = b.unit AND k.position BETWEEN s AND e GROUP BY ALL""")
def cl8(s, d):
    return L.segment_validation(blocks(s, d), calls(s, d)).withColumn("agreement", F.round("agreement", 6))


_CONTACT = "(SELECT unit, position, count(DISTINCT entry) FILTER (quantity > 35) / count(DISTINCT entry) AS fraction FROM rec GROUP BY ALL HAVING count(DISTINCT entry) >= 3)"


@query("CL9_site_definitions", f"""WITH cur AS (SELECT * FROM {_SITES} WHERE unit % 3 <> 0), w AS (SELECT n_nationkey AS unit, CASE WHEN (p - 1) // 10 = 1 THEN 'POCKET' ELSE 'GROOVE' END AS site, p AS position FROM nation, (SELECT unnest(range(1, 51)) AS p) WHERE (p - 1) // 10 IN (1, 3))
SELECT unit, site, position, 'RESIDUE' AS level FROM cur UNION ALL SELECT unit, 'CONTACT_SITE', position, 'CONTACT' FROM {_CONTACT} WHERE fraction >= 0.35 UNION ALL SELECT unit, site, position, 'SEGMENT' FROM w WHERE NOT EXISTS (SELECT 1 FROM cur WHERE cur.unit = w.unit AND cur.site = w.site)""")
def cl9(s, d):
    rows = table(s, d, "nation").select(c("n_nationkey").alias("unit"), F.explode(F.sequence(F.lit(1), F.lit(50))).alias("position")).withColumn("segment", segment_of(c("position")))
    contacts = A.contact_consensus(rec(s, d), ["unit", "position"], "entry", c("quantity") > 35)
    return L.site_definitions(rows, contacts, sites(s, d).where("unit % 3 <> 0"), {"S1": "POCKET", "S3": "GROOVE"}, "CONTACT_SITE", 0.35)


_SCORES = f"""(SELECT p.unit, p.entry, x.site, count(*) FILTER (list_contains(x.pos, p.position)) AS n_site, count(*) FILTER (NOT list_contains(x.pos, p.position)) AS n_background, median(z) FILTER (list_contains(x.pos, p.position)) AS sm, avg(z) FILTER (list_contains(x.pos, p.position)) AS sa, median(z) FILTER (NOT list_contains(x.pos, p.position)) AS bm, len(any_value(x.pos)) AS size FROM prof p JOIN (SELECT unit, site, list(position) AS pos FROM {_SITES} GROUP BY ALL) x ON x.unit = p.unit GROUP BY p.unit, p.entry, x.site HAVING n_site > 0 AND n_background >= 1)"""


@query("CL10_entry_site_scores", f"""SELECT unit, entry, site, n_site, n_background, round(sm, 6) + 0.0 AS site_median, round(sa, 6) + 0.0 AS site_mean, round(sm - bm, 6) + 0.0 AS delta, round(n_site / size, 6) AS coverage FROM {_SCORES}""")
def cl10(s, d):
    g = L.entry_site_scores(prof(s, d), sites(s, d))
    return g.select("unit", "entry", "site", "n_site", "n_background", *((F.round(x, 6) + 0.0).alias(x) for x in ("site_median", "site_mean", "delta", "coverage")))


_O = "(SELECT unit, site, d AS v, row_number() OVER (PARTITION BY unit, site ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY unit, site) AS n FROM s)"
_S = f"s AS MATERIALIZED (SELECT *, round(sm - bm, 9) AS d FROM {_SCORES})"


@query("CL11_unit_site_summary", f"""WITH {_S}, o AS MATERIALIZED {_O}, m AS (SELECT unit, site, b, median(v) AS m FROM {_draws('o', 'unit, site', 1)} GROUP BY ALL), ci AS (SELECT unit, site, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m GROUP BY ALL)
SELECT unit, site, count(*) AS n_entries, round(median(d), 6) AS median_delta, round(quantile_cont(d, 0.75) - quantile_cont(d, 0.25), 6) AS iqr, round(avg(n_site / size), 6) AS coverage, round(any_value(lo), 6) AS ci_low, round(any_value(hi), 6) AS ci_high FROM s JOIN ci USING (unit, site) GROUP BY unit, site""")
def cl11(s, d):
    g = L.unit_site_summary(scores(s, d))
    return g.select("unit", "site", "n_entries", *(F.round(x, 6).alias(x) for x in ("median_delta", "iqr", "coverage", "ci_low", "ci_high")))


def scores(s, d):
    """Deltas are rounded before they are ranked, so that ties are the same in any engine."""
    return L.entry_site_scores(prof(s, d), sites(s, d)).withColumn("delta", F.round("delta", 9))


def segmap(s, d):
    p = table(s, d, "part").select(c("p_size").alias("position")).distinct()
    i = F.floor((c("position") - 1) / 10)
    return p.withColumns({"segment": segment_of(c("position")), "cls": F.when(i % 2 == 0, "HELIX").otherwise("LOOP")})


_CONTROLS = f"""(WITH m AS (SELECT DISTINCT p_size AS position, (p_size - 1) // 10 AS seg, (p_size - 1) // 10 % 2 AS cls FROM part), x AS (SELECT unit, site, list(position) AS pos, list(DISTINCT seg) AS segs, list(DISTINCT cls) AS clss FROM {_SITES} JOIN m USING (position) GROUP BY ALL), j AS (SELECT x.*, m.* FROM x, m WHERE NOT list_contains(pos, m.position)),
t AS (SELECT unit, site, CASE WHEN count(*) FILTER (list_contains(segs, seg)) >= 5 THEN 'same_segment' WHEN count(*) FILTER (list_contains(clss, cls)) >= 5 THEN 'same_class' ELSE 'named_only' END AS tier FROM j GROUP BY ALL) SELECT j.unit, j.site, j.position, tier FROM j JOIN t USING (unit, site) WHERE CASE tier WHEN 'same_segment' THEN list_contains(segs, seg) WHEN 'same_class' THEN list_contains(clss, cls) ELSE true END)"""


@query("CL12_matched_controls", f"SELECT * FROM {_CONTROLS}")
def cl12(s, d):
    return L.matched_controls(sites(s, d), segmap(s, d))


@query("CL13_matched_scores", f"""WITH k AS MATERIALIZED (SELECT unit, site, list(position) AS bg FROM {_CONTROLS} GROUP BY ALL), x AS (SELECT unit, site, list(position) AS pos FROM {_SITES} GROUP BY ALL)
SELECT p.unit, p.entry, x.site, count(*) FILTER (list_contains(pos, p.position)) AS n_site, count(*) FILTER (list_contains(bg, p.position)) AS n_background, round(median(z) FILTER (list_contains(pos, p.position)) - median(z) FILTER (list_contains(bg, p.position)), 6) AS delta FROM prof p JOIN x ON x.unit = p.unit JOIN k ON k.unit = x.unit AND k.site = x.site GROUP BY p.unit, p.entry, x.site HAVING n_site > 0 AND n_background >= 3""")
def cl13(s, d):
    g = L.entry_site_scores(prof(s, d), sites(s, d), L.matched_controls(sites(s, d), segmap(s, d)).drop("tier"), 3)
    return g.select("unit", "entry", "site", "n_site", "n_background", F.round("delta", 6).alias("delta"))


_CONFIRM = f"(SELECT site, round(median(round(sm - bm, 9)), 9) AS d FROM {_SCORES} WHERE unit % 5 <> 0 GROUP BY unit, site)"


@query("CL14_confirmatory_reanalysis", f"""SELECT site, n_pairs, n, w_plus, round(rank_biserial, 6) AS rank_biserial, round(p, 6) AS p, round(q, 6) AS q, 'TESTED' AS status FROM {tails.with_q("(SELECT * FROM " + tails.signed_rank(_CONFIRM, 'site') + " WHERE n_pairs >= 3)", '', 'site')}""")
def cl14(s, d):
    summed = L.unit_site_summary(scores(s, d)).withColumn("median_delta", F.round("median_delta", 9))
    g = L.confirmatory_reanalysis(summed, sites(s, d).where("unit % 5 <> 0"))
    return g.select("site", "n_pairs", "n", "w_plus", *(F.round(x, 6).alias(x) for x in ("rank_biserial", "p", "q")), "status")


@query("CL15_atlas", f"""WITH u AS MATERIALIZED (SELECT segment, round(v, 9) AS v FROM unitseg), o AS MATERIALIZED (SELECT segment, v, row_number() OVER (PARTITION BY segment ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY segment) AS n FROM u), m AS (SELECT segment, b, median(v) AS m FROM {_draws('o', 'segment', 1)} GROUP BY ALL), ci AS (SELECT segment, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m GROUP BY segment)
SELECT segment, count(*) AS n, round(median(v), 6) AS median, round(avg(v), 6) AS mean, round(any_value(lo), 6) AS ci_low, round(any_value(hi), 6) AS ci_high, round(avg((v > 0)::INT), 6) AS share_up, round(avg((v < 0)::INT), 6) AS share_down, rank() OVER (ORDER BY median(v) DESC) AS rank FROM u JOIN ci USING (segment) GROUP BY segment""")
def cl15(s, d):
    g = L.atlas(unitseg(s, d).withColumn("v", F.round("v", 9)))
    return g.select("segment", "n", *(F.round(x, 6).alias(x) for x in ("median", "mean", "ci_low", "ci_high", "share_up", "share_down")), "rank")


_SCHEME = """(SELECT '{name}' AS scheme, segment, k, n, h, h / (n - 1) AS epsilon2, CASE k WHEN 2 THEN NULL WHEN 3 THEN exp(-h / 2) WHEN 5 THEN exp(-h / 2) * (1 + h / 2) END AS p FROM (
 WITH f AS (SELECT segment, {group} AS g, round(v, 6) AS v FROM unitseg), b AS (SELECT * FROM f QUALIFY count(*) OVER (PARTITION BY segment, g) >= 3),
 r AS (SELECT *, rank() OVER (PARTITION BY segment ORDER BY v) + (count(*) OVER (PARTITION BY segment, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY segment, v) AS t FROM b),
 s AS (SELECT segment, g, count(*) AS n, sum(r) AS rs, sum(t * t - 1) AS ties FROM r GROUP BY ALL), k AS (SELECT segment, count(*) AS k, sum(n) AS n, sum(rs * rs / n) AS q, sum(ties) AS ties FROM s GROUP BY segment)
 SELECT segment, k, n::BIGINT AS n, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n ** 3 - n)) AS h FROM k WHERE k >= 2))"""
_SCHEMES = "(SELECT * FROM " + _SCHEME.format(name="region", group="grp") + " UNION ALL SELECT * FROM " + _SCHEME.format(name="thirds", group="unit % 3") + ")"


@query("CL16_omnibus", f"""SELECT scheme, segment, k, n, round(h, 6) AS h, round(epsilon2, 6) AS epsilon2, round(p, 6) AS p, round(q, 6) AS q, 'TESTED' AS status FROM {tails.with_q(_SCHEMES, 'scheme', 'segment')}""")
def cl16(s, d):
    # five regions and three thirds: an even number of degrees of freedom, whose tail SQL can say
    u = unitseg(s, d).withColumns({"v": F.round("v", 6), "parity": c("unit") % 3})
    g = L.omnibus(u, {"region": "grp", "thirds": "parity"}, "segment", "v")
    return g.select("scheme", "segment", "k", "n", *(F.round(x, 6).alias(x) for x in ("h", "epsilon2", "p", "q")), "status")


@query("CL17_state_comparison", f"""SELECT unit, segment, n1, n2, u, round(delta, 6) AS delta, round(median_delta, 8) AS median_delta, tier, round(p, 6) AS p, round(q, 6) AS q, round(q_global, 6) AS q_global FROM {tails.with_q(tails.with_q(_TESTS_P, 'unit', 'segment'), '', 'unit, segment', 'q_global')}""")
def cl17(s, d):
    from .catalogue import state_comparison

    return state_comparison(s, d).select("unit", "segment", "n1", "n2", "u", *(F.round(x, 6).alias(x) for x in ("delta", "p", "q", "q_global")), F.round("median_delta", 8).alias("median_delta"), "tier")


_PROF = "(SELECT unit, position, state AS s, round(z, 6) AS v FROM prof)"


@query("CL17b_position_comparison", f"""SELECT unit, position, n1, n2, u, tier, round(p, 6) AS p, round(q, 6) AS q, round(q_global, 6) AS q_global FROM {tails.with_q(tails.with_q(tails.mann_whitney(_PROF, 'unit, position'), 'unit', 'position'), '', 'unit, position', 'q_global')}""")
def cl17b(s, d):
    g = L.position_comparison(prof(s, d).withColumn("z", F.round("z", 6)), "z")
    return g.select("unit", "position", "n1", "n2", "u", "tier", *(F.round(x, 6).alias(x) for x in ("p", "q", "q_global")))


@query("CL18_curated_site_scores", f"""WITH e AS (SELECT unit, entry, position, median(z) AS z FROM norm WHERE z IS NOT NULL GROUP BY ALL), x AS (SELECT * FROM {_SITES} WHERE site = 'GROOVE'), f AS (SELECT unit, entry, site, avg(z) AS m FROM e JOIN x USING (unit, position) GROUP BY ALL HAVING count(*) = 3)
SELECT x.unit, x.site, round(s, 6) AS score, coalesce(n, 0) AS n_entries FROM (SELECT DISTINCT unit, site FROM x) x LEFT JOIN (SELECT unit, site, median(m) AS s, count(*) AS n FROM f GROUP BY ALL) g ON g.unit = x.unit AND g.site = x.site""")
def cl18(s, d):
    groove = sites(s, d).where("site = 'GROOVE'")
    g = L.curated_site_scores(fixtures._prof(s, d, groove), groove)
    return g.withColumn("score", F.round("score", 6))


_NEAR = "(SELECT a.label, a.vec_id AS p, b.vec_id AS q FROM pts a JOIN pts b ON a.label = b.label AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 6.0 WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1)"


@query("CL19_ligand_states", f"""SELECT label, vec_id AS point, CASE WHEN vec_id IN (SELECT p FROM {_NEAR} WHERE q % 3 = 0) THEN 'HOLO' WHEN vec_id IN (SELECT p FROM {_NEAR} WHERE q % 3 = 1) THEN 'AMBIGUOUS' ELSE 'APO' END AS state FROM pts WHERE vec_id % 2 = 0""")
def cl19(s, d):
    p = pts(s, d)
    kind = F.when(c("vec_id") % 3 == 0, "FUNCTIONAL").when(c("vec_id") % 3 == 1, "UNRESOLVED").otherwise("ADDITIVE")
    return L.ligand_states(p.where("vec_id % 2 = 0"), p.where("vec_id % 2 = 1"), "label", "vec_id", "vec_id", kind, 6.0)


@query("CL19b_partner_states", f"""SELECT label, probe AS doc_id, min_distance, positions, CASE WHEN lang = 'fr' THEN 'KNOWN' WHEN n_chars <= 5000 AND (contains(lower(text), 'license') OR contains(lower(text), 'copyright')) THEN 'LEGAL' WHEN n_chars <= 5000 AND contains(lower(text), 'token') THEN 'SECRET' ELSE 'OTHER' END AS category FROM {_probes_sql(False)} LEFT JOIN documents ON doc_id = probe WHERE within_near""")
def cl19b(s, d):
    """Partners described by the documents of the same number."""
    t = contact_atoms(s, d)
    docs = table(s, d, "documents").select("doc_id", "text", "n_chars", "lang")
    g = L.partner_states(
        t.withColumnRenamed("occ_point", "occ"), t.withColumnRenamed("occ_probe", "occ").withColumnRenamed("probe", "doc_id"), docs, "label", "position", "doc_id", "occ", 4.5,
        "text", "n_chars", {"LEGAL": ["license", "copyright"], "SECRET": ["token"]}, 5000, c("lang") == "fr", "KNOWN",
    )
    return g.withColumns({"min_distance": F.round("min_distance", 6), "positions": F.concat_ws(",", "positions")})


@query("CL20_interpretation_table", f"""SELECT t.unit, t.segment, t.position, CASE WHEN t.segment = 'S0' THEN 'FIRST' WHEN starts_with(t.segment, 'S') THEN 'BODY' ELSE 'OTHER' END AS category, (SELECT min({{'d': abs(x.position - t.position), 's': x.position}}) FROM {_SITES} x WHERE x.unit = t.unit AND abs(x.position - t.position) <= 3).s AS nearest FROM (SELECT unit, segment, (substr(segment, 2)::INT * 10 + 6) AS position FROM unitseg) t""")
def cl20(s, d):
    t = unitseg(s, d).select("unit", "segment", (F.substring("segment", 2, 9).cast("int") * 10 + 6).alias("position"))
    x = sites(s, d).select("unit", c("position").alias("site_position"))
    return L.interpretation_table(t, x, {"S0": "FIRST"}, {"S": "BODY"}).select("unit", "segment", "position", "category", "nearest")


@query("CL21_flags_low_quality", """SELECT p_partkey, p_type = 'ECONOMY' AS low_confidence, p_size / 50 < 0.5 AS low_coverage, p_size % 2 = 1 AS segment_only FROM part""")
def cl21(s, d):
    p = table(s, d, "part").select("p_partkey", F.when(c("p_type") == "ECONOMY", "LOW").otherwise("HIGH").alias("confidence"), (c("p_size") / 50).alias("coverage"), F.when(c("p_size") % 2 == 1, "SEGMENT").otherwise("RESIDUE").alias("level"))
    return L.flags_low_quality(p).select("p_partkey", "low_confidence", "low_coverage", "segment_only")


_SITE_D = f"(SELECT unit, site, round(round(sm, 9) - round(bm, 9), 9) AS d FROM {_SCORES})"


@query("ST14b_site_effects", f"""SELECT unit, site, n, w_plus, round(p, 6) AS p FROM {tails.signed_rank(_SITE_D, 'unit, site')} WHERE n_pairs >= 5""")
def st14b(s, d):
    """Site deltas of each unit tested against its matched background, paired by entry."""
    g = L.entry_site_scores(prof(s, d), sites(s, d)).select("unit", "site", F.round(F.round("site_median", 9) - F.round("background_median", 9), 9).alias("a"), F.lit(0.0).alias("b"))
    return S.wilcoxon_paired(g, ["unit", "site"], "a", "b").select("unit", "site", "n", "w_plus", F.round("p", 6).alias("p"))


@query("AG30b_state_effects", f"""SELECT unit, count(*) AS n_tested, arg_min(segment, median_delta) AS lowest, arg_max(segment, median_delta) AS highest FROM {_TESTS_P} GROUP BY unit""")
def ag30b(s, d):
    from .catalogue import state_comparison

    return A.effect_summary(state_comparison(s, d), "unit", "segment", "median_delta").select("unit", "n_tested", "lowest", "highest")
