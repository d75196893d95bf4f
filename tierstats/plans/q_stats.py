"""Queries of the statistics operators. Statistics have SQL; tail probabilities are tested against known values."""

from pyspark.sql import functions as F

from tierstats.operators import aggregate as A
from tierstats.operators import joins as J
from tierstats.operators import loo as L
from tierstats.operators import resample as B
from tierstats.operators import stats as S
from tierstats.operators import windows as W
from tierstats.sources.fixtures import feat, prof, rec, table, unitseg

from . import tails
from .registry import query

c = F.col
R6 = lambda *cols: [F.round(x, 6).alias(x) for x in cols]
T = ["unit", "segment"]

#: Values are rounded before they are ranked, so that ties are the same in any engine.
_F = "(SELECT unit, grp, entry, state, resolution, segment, n, round(v, 6) AS v, round(mean_v, 6) AS mean_v FROM feat)"
_MW = """(WITH f AS (SELECT * FROM {src} WHERE s IN ('{a}', '{b}') AND v IS NOT NULL),
  r AS (SELECT *, rank() OVER (PARTITION BY {t} ORDER BY v) + (count(*) OVER (PARTITION BY {t}, v) - 1) / 2.0 AS r FROM f),
  g AS (SELECT {t}, count(*) FILTER (s = '{a}') AS n1, count(*) FILTER (s = '{b}') AS n2, sum(r) FILTER (s = '{a}') AS rs, median(v) FILTER (s = '{a}') AS m1, median(v) FILTER (s = '{b}') AS m2 FROM r GROUP BY {t})
  SELECT {t}, n1, n2, rs - n1 * (n1 + 1) / 2.0 AS u, 2 * (rs - n1 * (n1 + 1) / 2.0) / (n1 * n2) - 1 AS delta, m1 - m2 AS median_delta, CASE WHEN least(n1, n2) >= 5 THEN 'PRIMARY' ELSE 'EXPLORATORY' END AS tier FROM g WHERE least(n1, n2) >= {least})"""


def _mw(src, t="unit, segment", a="HOLO", b="APO", least=3):
    return _MW.format(src=src, t=t, a=a, b=b, least=least)


def rounded(s, d):
    return feat(s, d).withColumns({"v": F.round("v", 6), "mean_v": F.round("mean_v", 6)})


def _tests(s, d):
    return S.mann_whitney(rounded(s, d), T, "state", "v")


_BASE = _mw(f"(SELECT *, state AS s FROM {_F})")


@query("ST1_mann_whitney", f"""SELECT unit, segment, n1, n2, u, round(delta, 6) AS delta, round(median_delta, 8) AS median_delta, tier FROM {_BASE}""")
def st1(s, d):
    return _tests(s, d).select(*T, "n1", "n2", "u", F.round("delta", 6).alias("delta"), F.round("median_delta", 8).alias("median_delta"), "tier")


_TESTS_P = tails.mann_whitney(f"(SELECT *, state AS s FROM {_F})")


@query("ST1_mann_whitney_p", f"""SELECT unit, segment, n1, n2, u, round(p, 6) AS p, round(q, 6) AS q FROM {tails.with_q(_TESTS_P, 'unit', 'segment')}""")
def st1p(s, d):
    return W.bh_fdr(_tests(s, d), "p", ["unit"], ["segment"]).select(*T, "n1", "n2", "u", *R6("p", "q"))


@query("ST2_cliffs_delta", f"""SELECT unit, segment, round(delta, 6) AS delta FROM {_BASE}""")
def st2(s, d):
    return _tests(s, d).select(*T, F.round(S.cliffs_delta(c("u"), c("n1"), c("n2")), 6).alias("delta"))


_KW = """(WITH f AS (SELECT segment, grp, {v} AS v, unit FROM unitseg), z AS (SELECT segment, grp FROM f GROUP BY ALL HAVING count(*) >= 3), b AS (SELECT f.* FROM f JOIN z USING (segment, grp)),
 r AS (SELECT *, rank() OVER (PARTITION BY segment ORDER BY v) + (count(*) OVER (PARTITION BY segment, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY segment, v) AS t FROM b),
 g AS (SELECT segment, grp, count(*) AS n, sum(r) AS rs, sum(t * t - 1) AS ties FROM r GROUP BY ALL),
 k AS (SELECT segment, count(*) AS k, sum(n) AS n, sum(rs * rs / n) AS q, sum(ties) AS ties FROM g GROUP BY segment)
 SELECT segment, k, n::BIGINT AS n, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n ** 3 - n)) AS h FROM k WHERE k >= 2)"""


@query("ST3_kruskal", f"""SELECT segment, k, n, round(h, 6) AS h, round(h / (n - 1), 6) AS epsilon2, round(exp(-h / 2) * (1 + h / 2), 6) AS p, 'TESTED' AS status FROM {_KW.format(v='round(v, 6)')}""")
def st3(s, d):
    # five groups: four degrees of freedom, whose tail is exp(-h/2) (1 + h/2)
    k = S.kruskal(unitseg(s, d).withColumn("v", F.round("v", 6)), ["segment"], "grp", "v")
    return k.select("segment", "k", "n", *R6("h", "epsilon2", "p"), "status")


_PAIRS = f"""(SELECT segment, CASE WHEN a.grp < b.grp THEN a.grp ELSE b.grp END AS a, CASE WHEN a.grp < b.grp THEN b.grp ELSE a.grp END AS b, CASE WHEN a.grp < b.grp THEN 'A' ELSE 'B' END AS s, v FROM (SELECT segment, grp, entry, round(v, 6) AS v FROM feat WHERE segment IN ('S1', 'S2')) a JOIN (SELECT DISTINCT grp FROM feat) b ON a.grp <> b.grp)"""


@query("ST4_posthoc", f"""SELECT segment, a, b, n1, n2, u, round(delta, 6) AS delta FROM {_mw(_PAIRS, 'segment, a, b', 'A', 'B', 2)}""")
def st4(s, d):
    some = table(s, d, "nation").select(F.explode(F.array(F.lit("S1"), F.lit("S2"))).alias("segment")).distinct()
    return S.posthoc(rounded(s, d), some, ["segment"], "grp", "v").select("segment", "a", "b", "n1", "n2", "u", F.round("delta", 6).alias("delta"))


_WX = """(WITH r AS (SELECT *, rank() OVER (PARTITION BY {t} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {t}, abs(d)) - 1) / 2.0 AS r FROM {src} WHERE d <> 0)
 SELECT {t}, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, (2 * sum(CASE WHEN d > 0 THEN r ELSE 0 END) - sum(r)) / sum(r) AS rank_biserial FROM r GROUP BY {t})"""
_ENT = f"""(SELECT unit, entry, max(v) FILTER (segment = 'S0') AS a, max(v) FILTER (segment = 'S1') AS b, max(v) FILTER (segment = 'S0') - max(v) FILTER (segment = 'S1') AS d FROM {_F} GROUP BY ALL HAVING a IS NOT NULL AND b IS NOT NULL)"""


def _entries(s, d):
    g = rounded(s, d).groupBy("unit", "entry").agg(F.max(F.when(c("segment") == "S0", c("v"))).alias("a"), F.max(F.when(c("segment") == "S1", c("v"))).alias("b"))
    return g.where("a is not null and b is not null")


@query("ST5_wilcoxon_paired", f"""SELECT unit, n, w_plus FROM {_WX.format(t='unit', src=_ENT)} JOIN (SELECT unit FROM {_ENT} GROUP BY unit HAVING count(*) >= 5) USING (unit)""")
def st5(s, d):
    return S.wilcoxon_paired(_entries(s, d), ["unit"], "a", "b").select("unit", "n", "w_plus")


@query("ST5_wilcoxon_paired_p", f"""SELECT unit, n, w_plus, round(p, 6) AS p FROM {tails.signed_rank(_ENT, 'unit')} WHERE n_pairs >= 5""")
def st5p(s, d):
    return S.wilcoxon_paired(_entries(s, d), ["unit"], "a", "b").select("unit", "n", "w_plus", *R6("p"))


_US = "(SELECT unit, segment, round(v, 6) AS d FROM unitseg)"


@query("ST6_wilcoxon_one_sample", f"""SELECT segment, n, w_plus, 'TESTED' AS status FROM {_WX.format(t='segment', src=_US)}""")
def st6(s, d):
    return S.wilcoxon_one_sample(unitseg(s, d).withColumn("v", F.round("v", 6)), ["segment"], "v").select("segment", "n", "w_plus", "status")


@query("ST7_rank_biserial", f"""SELECT unit, round(rank_biserial, 6) AS rank_biserial FROM {_WX.format(t='unit', src=_ENT)} JOIN (SELECT unit FROM {_ENT} GROUP BY unit HAVING count(*) >= 5) USING (unit)""")
def st7(s, d):
    return S.wilcoxon_paired(_entries(s, d), ["unit"], "a", "b").select("unit", F.round("rank_biserial", 6).alias("rank_biserial"))


_CP = "(SELECT x.segment AS a, y.segment AS b, round(x.v, 6) - round(y.v, 6) AS d FROM unitseg x JOIN unitseg y ON x.unit = y.unit AND x.segment < y.segment)"


@query("ST8_pairwise_classes", f"""SELECT a, b, n, w_plus FROM {_WX.format(t='a, b', src=_CP)}""")
def st8(s, d):
    return S.pairwise_classes(unitseg(s, d).withColumn("v", F.round("v", 6)), "unit", "segment", "v").select("a", "b", "n", "w_plus")


def _draws(o: str, key: str, seed: int) -> str:
    """(key, b, v): the resampled values of ``o`` (key, i, n, v)."""
    return f"""(SELECT {key}, b, o.v FROM (SELECT {key}, b, (((b * 7919 + i * 104729 + {seed} * 15485 + 1) % 2147483647 * 48271 % 2147483647) * 69621) % 2147483647 % n AS i FROM {o}, generate_series(0, 1999) AS g(b)) JOIN {o} o USING ({key}, i))"""


_SEG = "(SELECT segment, round(v, 6) AS v, row_number() OVER (PARTITION BY segment ORDER BY round(v, 6)) - 1 AS i, count(*) OVER (PARTITION BY segment) AS n FROM unitseg)"
_CI = "round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high"


@query("ST9_bootstrap_ci", f"""WITH o AS MATERIALIZED {_SEG}, m AS (SELECT segment, b, median(v) AS m FROM {_draws('o', 'segment', 1)} GROUP BY ALL) SELECT segment, {_CI} FROM m GROUP BY segment""")
def st9(s, d):
    return S.bootstrap_ci(unitseg(s, d).withColumn("v", F.round("v", 6)), ["segment"], "v").select("segment", *R6("ci_low", "ci_high"))


_SIDE = "(SELECT segment, round(v, 6) AS v, row_number() OVER (PARTITION BY segment ORDER BY round(v, 6)) - 1 AS i, count(*) OVER (PARTITION BY segment) AS n FROM feat WHERE state = '{}')"


@query("ST9b_bootstrap_difference", f"""WITH x AS MATERIALIZED {_SIDE.format('HOLO')}, y AS MATERIALIZED {_SIDE.format('APO')}, a AS (SELECT segment, b, median(v) AS m FROM {_draws('x', 'segment', 1)} GROUP BY ALL), z AS (SELECT segment, b, median(v) AS m FROM {_draws('y', 'segment', 2)} GROUP BY ALL), m AS (SELECT segment, b, a.m - z.m AS m FROM a JOIN z USING (segment, b)) SELECT segment, {_CI} FROM m GROUP BY segment""")
def st9b(s, d):
    return S.bootstrap_difference(rounded(s, d), ["segment"], "state", "v").select("segment", *R6("ci_low", "ci_high"))


@query("ST9c_bootstrap_epsilon2", f"""WITH o AS MATERIALIZED (SELECT segment, grp, round(v, 6) AS v, row_number() OVER (PARTITION BY segment, grp ORDER BY round(v, 6)) - 1 AS i, count(*) OVER (PARTITION BY segment, grp) AS n FROM unitseg QUALIFY n >= 3),
p AS (SELECT segment, grp, b, v FROM {_draws('o', 'segment, grp', 1)}), r AS (SELECT *, rank() OVER (PARTITION BY segment, b ORDER BY v) + (count(*) OVER (PARTITION BY segment, b, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY segment, b, v) AS t FROM p),
g AS (SELECT segment, b, grp, count(*) AS n, sum(r) AS rs, sum(t * t - 1) AS ties FROM r GROUP BY ALL), k AS (SELECT segment, b, sum(n) AS n, sum(rs * rs / n) AS q, sum(ties) AS ties FROM g GROUP BY segment, b HAVING count(*) >= 2),
m AS (SELECT segment, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / nullif(1 - ties / (n ** 3 - n), 0) / (n - 1) AS m FROM k) SELECT segment, {_CI} FROM m GROUP BY segment""")
def st9c(s, d):
    return S.bootstrap_epsilon2(unitseg(s, d).withColumn("v", F.round("v", 6)), ["segment"], "grp", "v").select("segment", *R6("ci_low", "ci_high"))


def _mixed(x: str, p: str) -> str:
    """SQL columns that mix the 32-bit number x; the last is p5."""
    u, full = "::UBIGINT", "4294967295::UBIGINT"
    return f"({x}) & {full} AS {p}0, xor({p}0, {p}0 >> 16) AS {p}1, ({p}1 * {B.MIX_1}{u}) & {full} AS {p}2, xor({p}2, {p}2 >> 13) AS {p}3, ({p}3 * {B.MIX_2}{u}) & {full} AS {p}4, xor({p}4, {p}4 >> 16) AS {p}5"


_STEPS = " + ".join(f"(h5 >= {x})::BIGINT" for x in B.poisson_steps())


@query("ST9d_mergeable_bootstrap", f"""WITH o AS MATERIALIZED (SELECT segment, v, (row_number() OVER (PARTITION BY segment ORDER BY v, unit, entry) - 1)::UBIGINT AS i FROM {_F}), b AS (SELECT range::BIGINT AS b, {_mixed(f'range::UBIGINT * {B.STEP}::UBIGINT + 1', 'g')} FROM range(500)),
h AS (SELECT segment, v, i, b, {_mixed(f'i * {B.STEP}::UBIGINT + g5', 'h')} FROM o, b), w AS (SELECT segment, v, i, b, {_STEPS} AS w FROM h),
c AS (SELECT segment, v, b, sum(w) OVER (PARTITION BY segment, b ORDER BY i) AS upto, sum(w) OVER (PARTITION BY segment, b) AS total FROM w WHERE w > 0),
m AS (SELECT segment, b, (min(v) FILTER (upto > (total - 1) // 2) + min(v) FILTER (upto > total // 2)) / 2 AS m FROM c GROUP BY segment, b)
SELECT segment, n, {_CI} FROM m JOIN (SELECT segment, count(*) AS n FROM o GROUP BY segment) USING (segment) GROUP BY segment, n""")
def st9d(s, d):
    """By weights, with ranges of a few hundred rows, so that a test is in many."""
    return B.mergeable_bootstrap(rounded(s, d), ["segment"], ["unit", "entry"], "v", 500, plain_rows=0, part_rows=400).select("segment", "n", *R6("ci_low", "ci_high"))


@query("ST10_loo_median", f"""WITH f AS {_F}, l AS (SELECT x.unit, x.segment, x.entry AS o, median(y.v) AS m FROM f x JOIN f y ON x.unit = y.unit AND x.segment = y.segment AND x.entry <> y.entry GROUP BY ALL), m AS (SELECT unit, segment, count(*) AS n, median(v) AS md FROM f GROUP BY ALL HAVING count(*) >= 3)
SELECT unit, segment, any_value(n) AS n, round(min(m), 8) AS loo_min, round(max(m), 8) AS loo_max, round(max(abs(m - md)), 8) AS max_shift FROM l JOIN m USING (unit, segment) GROUP BY unit, segment""")
def st10(s, d):
    return L.loo_median(rounded(s, d), T, ["entry"], "v").select(*T, "n", *(F.round(x, 8).alias(x) for x in ("loo_min", "loo_max", "max_shift")))


_FOLD = f"(SELECT x.*, x.state AS s, o.entry AS left_out FROM {_F} x JOIN (SELECT DISTINCT unit, segment, entry FROM feat WHERE state IN ('HOLO', 'APO')) o ON x.unit = o.unit AND x.segment = o.segment AND x.entry <> o.entry)"


@query("ST11_loo_tests", f"""SELECT f.unit, f.segment, count(*) AS n_folds, round(avg((f.p < 0.05)::INT), 6) AS share_significant, round(avg((sign(f.median_delta) = sign(b.median_delta))::INT), 6) AS share_same_sign, round(min(f.median_delta), 8) AS min_delta, round(max(f.median_delta), 8) AS max_delta FROM {tails.mann_whitney(_FOLD, 'unit, segment, left_out', least=2)} f JOIN {_BASE} b ON f.unit = b.unit AND f.segment = b.segment GROUP BY ALL""")
def st11(s, d):
    return L.loo_tests(rounded(s, d), T, "state", "v").select(*T, "n_folds", *R6("share_significant", "share_same_sign"), *(F.round(x, 8).alias(x) for x in ("min_delta", "max_delta")))


def _tail_of(h: str, k: str) -> str:
    """SQL of the chi-square tail of h with k - 1 degrees of freedom, k from 2 to 5."""
    root = tails.erfc("root")
    return f"(SELECT CASE {k} WHEN 2 THEN {root} WHEN 3 THEN exp(-{h} / 2) WHEN 4 THEN {root} + sqrt(2 * {h} / pi()) * exp(-{h} / 2) WHEN 5 THEN exp(-{h} / 2) * (1 + {h} / 2) END FROM (SELECT sqrt({h} / 2) AS root))"


def _loo_kruskal_sql(least: int) -> str:
    """Plain folds: every test again without one of its units, with the groups that are still large enough."""
    h = "(12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n ** 3 - n))"
    test = lambda src, t: f"""(WITH r AS (SELECT *, rank() OVER (PARTITION BY {t} ORDER BY v) + (count(*) OVER (PARTITION BY {t}, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY {t}, v) AS tie FROM (SELECT *, count(*) OVER (PARTITION BY {t}, grp) AS ng FROM {src}) WHERE ng >= {least}),
  g AS (SELECT {t}, grp, count(*) AS n, sum(r) AS rs, sum(tie * tie - 1) AS ties FROM r GROUP BY ALL), k AS (SELECT {t}, count(*) AS k, sum(n) AS n, sum(rs * rs / n) AS q, sum(ties) AS ties FROM g GROUP BY ALL HAVING count(*) >= 2)
  SELECT {t}, {_tail_of('h', 'k')} AS p FROM (SELECT {t}, k, {h} AS h FROM k))"""  # noqa: E731
    fold = f"(SELECT b.segment, b.grp, b.v, o.unit AS o FROM b JOIN b o ON b.segment = o.segment AND b.unit <> o.unit)"
    return f"""(WITH f AS (SELECT segment, grp, unit, round(v, 6) AS v FROM unitseg), b AS (SELECT * FROM f QUALIFY count(*) OVER (PARTITION BY segment, grp) >= {least}), folds AS {test(fold, 'segment, o')}, whole AS {test('b', 'segment')}
  SELECT segment, {least} AS least, count(*) AS n_folds, any_value(w.p) AS p_full, min(x.p) AS p_min, max(x.p) AS p_max, avg(coalesce((x.p < 0.05)::INT, 0)) AS share FROM b JOIN whole w USING (segment) LEFT JOIN folds x ON x.segment = b.segment AND x.o = b.unit GROUP BY segment)"""


@query("ST11b_loo_kruskal", f"""SELECT segment, least, n_folds, round(p_full, 6) AS p_full, round(p_min, 6) AS p_min, round(p_max, 6) AS p_max, round(share, 6) AS share_significant, share < 1 AS depends FROM (FROM {_loo_kruskal_sql(3)} UNION ALL FROM {_loo_kruskal_sql(5)})""")
def st11b(s, d):
    """With groups of three units or more, and of five, where every fold loses a whole group."""
    u = unitseg(s, d).select("unit", "grp", "segment", F.round("v", 6).alias("v"))
    each = [L.loo_kruskal(u, ["segment"], "grp", "v", least).withColumn("least", F.lit(least)) for least in (3, 5)]
    return each[0].unionByName(each[1]).select("segment", "least", "n_folds", *R6("p_full", "p_min", "p_max", "share_significant"), "depends")


_DFOLD = f"(SELECT x.unit, x.d, o.entry AS o FROM {_ENT} x JOIN {_ENT} o ON x.unit = o.unit AND x.entry <> o.entry)"


@query("ST11c_loo_signed_rank", f"""WITH p AS {tails.signed_rank(_DFOLD, 'unit, o')}, w AS {tails.signed_rank(_ENT, 'unit')}, m AS (SELECT unit, o, median(d) AS m FROM {_DFOLD} GROUP BY ALL), a AS (SELECT unit, median(d) AS m FROM {_ENT} GROUP BY unit)
SELECT p.unit, w.n_pairs, round(w.p, 6) AS p_full, count(*) AS n_folds, round(avg((p.p < 0.05)::INT), 6) AS share_significant, round(avg((sign(m.m) = sign(a.m))::INT), 6) AS share_same_sign, bool_or((p.p < 0.05) <> (w.p < 0.05)) AS flips
FROM p JOIN w ON p.unit = w.unit JOIN m ON m.unit = p.unit AND m.o = p.o JOIN a ON a.unit = p.unit WHERE p.n_pairs >= 3 GROUP BY p.unit, w.n_pairs, w.p""")
def st11c(s, d):
    e = _entries(s, d).select("unit", (c("a") - c("b")).alias("d"))
    return L.loo_signed_rank(e, ["unit"], "d").select("unit", "n_pairs", *R6("p_full"), "n_folds", *R6("share_significant", "share_same_sign"), "flips")


_CROSS = "(SELECT unit, count(*) FILTER (quantity > 45 AND label = 'R') AS a, count(*) FILTER (quantity > 45 AND label <> 'R') AS b, count(*) FILTER (quantity <= 45 AND label = 'R') AS c, count(*) FILTER (quantity <= 45 AND label <> 'R') AS d FROM rec GROUP BY unit)"


@query("ST12_fisher_exact", f"""WITH t AS (SELECT *, a + b + c + d AS n, a + b AS r, a + c AS k FROM {_CROSS}), x AS (SELECT *, unnest(range(greatest(0, r + k - n), least(r, k) + 1)) AS i FROM t),
l AS (SELECT *, exp(lgamma(r + 1) - lgamma(i + 1) - lgamma(r - i + 1) + lgamma(n - r + 1) - lgamma(k - i + 1) - lgamma(n - r - k + i + 1) - lgamma(n + 1) + lgamma(k + 1) + lgamma(n - k + 1)) AS h FROM x), o AS (SELECT unit, h AS own FROM l WHERE i = a)
SELECT unit, a AS n11, b AS n10, c AS n01, d AS n00, CASE WHEN b * c > 0 THEN round(a * d / (b * c), 6) END AS odds_ratio, round(least(1, sum(h) FILTER (h <= own * (1 + 1e-7))), 6) AS p FROM l JOIN o USING (unit) WHERE r > 0 AND k > 0 AND r < n AND k < n GROUP BY ALL""")
def st12(s, d):
    return S.fisher_exact(A.crosstab_2x2(rec(s, d), ["unit"], c("quantity") > 45, c("label") == "R")).where("NOT degenerate").select("unit", "n11", "n10", "n01", "n00", *R6("odds_ratio", "p"))


_XY = "(SELECT unit, entry, round(avg(v), 6) AS x, round(resolution, 2) AS y FROM feat GROUP BY unit, entry, resolution)"


@query("ST13_correlate", f"""WITH f AS {_XY}, r AS (SELECT *, rank() OVER (PARTITION BY unit ORDER BY x) + (count(*) OVER (PARTITION BY unit, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY unit ORDER BY y) + (count(*) OVER (PARTITION BY unit, y) - 1) / 2.0 AS ry FROM f) SELECT unit, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY unit""")
def st13(s, d):
    f = feat(s, d).groupBy("unit", "entry", "resolution").agg(F.round(F.avg("v"), 6).alias("x")).withColumn("y", F.round("resolution", 2))
    return S.correlate(f, ["unit"], "x", "y").select("unit", "n", *R6("pearson", "spearman"))


_CONF = "(SELECT unit, state AS s, metric, v FROM (SELECT unit, entry, state, resolution::DOUBLE AS resolution, count(*)::DOUBLE AS n, round(avg(n_instances), 9) AS m FROM prof GROUP BY unit, entry, state, resolution) UNPIVOT (v FOR metric IN (resolution, n, m)))"


@query("ST14_balance_check", f"""SELECT unit, count(*) AS n_metrics, count(*) FILTER (p < 0.05) AS n_differ, count(*) FILTER (p < 0.05) = 0 AS balanced FROM {tails.mann_whitney(_CONF, 'unit, metric')} GROUP BY unit""")
def st14(s, d):
    e = prof(s, d).groupBy("unit", "entry", "state", "resolution").agg(F.count("*").alias("n"), F.round(F.avg("n_instances"), 9).alias("m"))
    return S.balance_check(e, "unit", "state", ["resolution", "n", "m"])


_BAND = f"(SELECT f.*, f.state AS s FROM {_F} f JOIN (SELECT unit, greatest(min(resolution) FILTER (state = 'HOLO'), min(resolution) FILTER (state = 'APO')) AS lo, least(max(resolution) FILTER (state = 'HOLO'), max(resolution) FILTER (state = 'APO')) AS hi FROM feat GROUP BY unit) b ON f.unit = b.unit AND f.resolution BETWEEN lo AND hi)"


@query("ST15_overlap_band_rerun", f"""SELECT t.unit, t.segment, n1, n2, u, CASE WHEN n1 IS NULL THEN 'NO_OVERLAP' ELSE 'RERUN' END AS status FROM (SELECT DISTINCT unit, segment FROM feat) t LEFT JOIN {_mw(_BAND)} m ON m.unit = t.unit AND m.segment = t.segment""")
def st15(s, d):
    return S.overlap_band_rerun(rounded(s, d), T, "unit", "state", "v", "resolution").select(*T, "n1", "n2", "u", "status")


def two_runs(s, d):
    """The two-state tests on the medians and on the means of the entries, as two runs to compare."""
    f = rounded(s, d)
    return tuple(S.mann_whitney(f, T, "state", v).select(*T, F.round("median_delta", 6).alias("eff"), F.round("p", 9).alias("p")) for v in ("v", "mean_v"))


_RUN = {v: "(SELECT unit, segment, round(median_delta, 6) AS eff, round(p, 9) AS p FROM " + tails.mann_whitney(f"(SELECT unit, segment, state AS s, {v} AS v FROM {_F})") + ")" for v in ("v", "mean_v")}


@query("ST16_interpret_sites", f"""WITH g AS (SELECT a.segment, count(*) AS n, count(*) FILTER (a.p < 0.05) AS nb, count(*) FILTER (a.p < 0.05 AND b.p < 0.05 AND sign(a.eff) = sign(b.eff)) AS nk FROM {_RUN['v']} a JOIN {_RUN['mean_v']} b USING (unit, segment) GROUP BY a.segment)
SELECT segment, n, nb AS n_before, nk AS n_kept, CASE WHEN n < 3 THEN 'INSUFFICIENT' WHEN nb = 0 THEN 'MIXED' WHEN nk / nb >= 0.7 THEN 'SITE_SPECIFIC' WHEN nk = 0 THEN 'CONTEXT_EXPLAINED' ELSE 'MIXED' END AS interpretation FROM g""")
def st16(s, d):
    return S.interpret_sites(J.compare_runs(*two_runs(s, d), T, "eff", "p"), "segment")


_SWAP = f"(SELECT a.segment, a.h AS h_first, b.h AS h_second, exp(-a.h / 2) * (1 + a.h / 2) AS p_first, exp(-b.h / 2) * (1 + b.h / 2) AS p_second FROM {_KW.format(v='round(v, 6)')} a JOIN {_KW.format(v='round(mean_of_means, 6)')} b USING (segment))"


def _swapped(s, d):
    f = unitseg(s, d).select("unit", "grp", "segment", F.round("v", 6).alias("v"), F.round("mean_of_means", 6).alias("m"))
    return S.sensitivity_swap(f, ["segment"], "grp", "v", "m")


@query("ST17_sensitivity_swap", f"""SELECT segment, round(h_first, 6) AS h_first, round(h_second, 6) AS h_second, round(p_first, 6) AS p_first, round(p_second, 6) AS p_second, (p_first < 0.05) = (p_second < 0.05) AS agree FROM {_SWAP}""")
def st17(s, d):
    return _swapped(s, d).select("segment", *R6("h_first", "h_second", "p_first", "p_second"), "agree")


@query("ST17b_swap_agreement", f"""WITH s AS MATERIALIZED (SELECT *, round(p_first, 9) AS p1, round(p_second, 9) AS p2 FROM {_SWAP}), r AS (SELECT *, rank() OVER (ORDER BY p1) + (count(*) OVER (PARTITION BY p1) - 1) / 2.0 AS a, rank() OVER (ORDER BY p2) + (count(*) OVER (PARTITION BY p2) - 1) / 2.0 AS b FROM s) SELECT count(*) AS n_tests, count(*) FILTER ((p_first < 0.05) = (p_second < 0.05)) AS n_agree, round(corr(a, b), 6) AS spearman FROM r""")
def st17b(s, d):
    return S.swap_agreement(_swapped(s, d), []).select("n_tests", "n_agree", *R6("spearman"))
