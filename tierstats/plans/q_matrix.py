"""Queries of the matrix operators: entries x segments, units x segments where rows are paired, and embeddings."""

from pyspark.sql import functions as F

from tierstats.operators import density as D
from tierstats.operators import matrix as M
from tierstats.operators import mixture as X
from tierstats.sources.fixtures import feat, pts, table, unitseg
from tierstats.sources.shared import staged

from .registry import query

c = F.col
NAMES = [f"S{i}" for i in range(5)]


def entries(s, d):
    return feat(s, d).select(c("entry").alias("id"), c("segment").alias("feature"), F.round("v", 6).alias("value"))


def units(s, d):
    return unitseg(s, d).select(c("unit").alias("id"), c("segment").alias("feature"), F.round("v", 6).alias("value"))


def gappy(s, d):
    """Units with some cells taken out, so that there is something to impute."""
    return units(s, d).where("NOT (id % 4 = 1 AND feature = 'S2')")


_E = "(SELECT entry AS id, segment AS feature, round(v, 6) AS value FROM feat)"
_U = "(SELECT unit AS id, segment AS feature, round(v, 6) AS value FROM unitseg)"
_G = f"(SELECT * FROM {_U} WHERE NOT (id % 4 = 1 AND feature = 'S2'))"
_D = "(SELECT a.id AS a, b.id AS b, sqrt(sum((a.value - b.value) ** 2)) AS d FROM {u} a JOIN {u} b ON a.feature = b.feature AND a.id <> b.id GROUP BY ALL)"
_L = "(SELECT DISTINCT unit AS id, (unit % 3)::INT AS cluster FROM unitseg)"


def _labels(s, d):
    return units(s, d).select("id", (c("id") % 3).alias("cluster")).distinct()


@query("ML1_impute_median", f"""SELECT i.id, f.feature, round(coalesce(value, m), 8) AS value, value IS NULL AS imputed FROM (SELECT DISTINCT id FROM {_E}) i CROSS JOIN (SELECT feature, median(value) AS m FROM {_E} GROUP BY feature) f LEFT JOIN {_E} e ON e.id = i.id AND e.feature = f.feature""")
def ml1(s, d):
    return M.impute_median(entries(s, d), entries(s, d)).withColumn("value", F.round("value", 8))


@query("ML2_impute_knn", f"""WITH g AS {_G}, ds AS (SELECT a.id AS a, b.id AS b, sqrt(sum((a.value - b.value) ** 2) * 5 / count(*)) AS d FROM g a JOIN g b ON a.feature = b.feature AND a.id <> b.id GROUP BY ALL), m AS (SELECT DISTINCT id FROM g WHERE id % 4 = 1), k AS (SELECT ds.a, d, value, row_number() OVER (PARTITION BY ds.a ORDER BY d, ds.b) AS r FROM ds JOIN m ON m.id = ds.a JOIN g ON g.id = ds.b AND g.feature = 'S2')
SELECT id, feature, round(value, 6) AS value, false AS imputed FROM g UNION ALL SELECT a, 'S2', round(sum(value / d) / sum(1 / d), 6), true FROM k WHERE r <= 5 GROUP BY a""")
def ml2(s, d):
    return M.impute_knn(gappy(s, d), gappy(s, d)).withColumn("value", F.round("value", 6))


@query("ML3_complete_case", f"""SELECT count(*) AS n_complete, CASE WHEN count(*) >= 10 THEN 'ADEQUATE' ELSE 'TOO_FEW' END AS status FROM (SELECT id FROM {_E} GROUP BY id HAVING count(DISTINCT feature) = 5)""")
def ml3(s, d):
    return M.complete_case(entries(s, d), NAMES)[1]


@query("ML4_standardise", f"""SELECT id, feature, round((value - avg(value) OVER (PARTITION BY feature)) / stddev_pop(value) OVER (PARTITION BY feature), 6) AS value FROM {_E}""")
def ml4(s, d):
    return M.standardise(entries(s, d)).withColumn("value", F.round("value", 6))


@query("ML5_pca")
def ml5(s, d):
    return M.pca(M.impute_median(entries(s, d), entries(s, d)).drop("imputed"), NAMES)[0]


_IMP = f"(SELECT i.id, f.feature, coalesce(value, m) AS value FROM (SELECT DISTINCT id FROM {_E}) i CROSS JOIN (SELECT feature, median(value) AS m FROM {_E} GROUP BY feature) f LEFT JOIN {_E} e ON e.id = i.id AND e.feature = f.feature)"
_TIMES = "(SELECT a.i, b.j, sum(a.c * b.c) AS c FROM {} a JOIN k b ON a.j = b.i GROUP BY ALL)"


@query("ML5b_pca_power_sums", f"""WITH v AS MATERIALIZED {_IMP}, c AS (SELECT a.feature AS i, b.feature AS j, covar_samp(a.value, b.value) AS c FROM v a JOIN v b USING (id) GROUP BY ALL), k AS MATERIALIZED (SELECT i, j, c / (SELECT sum(c) FROM c WHERE i = j) AS c FROM c),
k2 AS MATERIALIZED {_TIMES.format('k')}, k3 AS MATERIALIZED {_TIMES.format('k2')}, k4 AS MATERIALIZED {_TIMES.format('k3')}, k5 AS MATERIALIZED {_TIMES.format('k4')}
SELECT 1 AS power, round(sum(c), 6) AS total FROM k WHERE i = j UNION ALL SELECT 2, round(sum(c), 6) FROM k2 WHERE i = j UNION ALL SELECT 3, round(sum(c), 6) FROM k3 WHERE i = j UNION ALL SELECT 4, round(sum(c), 6) FROM k4 WHERE i = j UNION ALL SELECT 5, round(sum(c), 6) FROM k5 WHERE i = j""")
def ml5b(s, d):
    """Sums of the powers of the ratios, which are traces of powers of the covariance: five of them fix the five ratios."""
    r = M.pca(M.impute_median(entries(s, d), entries(s, d)).drop("imputed"), NAMES)[0]
    return r.select("ratio", F.explode(F.array(*map(F.lit, range(1, 6)))).alias("power")).groupBy("power").agg(F.round(F.sum(F.pow("ratio", "power")), 6).alias("total"))


def _v(s, d):
    """Written once: each k is a fit of its own."""
    v = M.vectors(M.standardise(units(s, d)), NAMES)
    return staged(v, "unit-vectors")


def _ks(s, d):
    """k from 2 to 10, or to one less than there are units."""
    return list(range(2, 1 + min(10, units(s, d).select("id").distinct().count() - 1)))


@query("ML6_kmeans")
def ml6(s, d):
    return M.kmeans(_v(s, d), _ks(s, d))


def _points(long):
    """(id, x) of the units that have all segments."""
    cell = lambda f: F.max(F.when(c("feature") == f, c("value")))
    return long.groupBy("id").agg(F.array(*(cell(f) for f in NAMES)).alias("x")).where(F.forall("x", F.isnotnull))


def _mixtures(s, d):
    points = staged(_points(M.standardise(units(s, d))), "unit-points")
    return X.diagonal_mixture(points, X.start_labels(points, _ks(s, d)))


@query("ML7_gmm")
def ml7(s, d):
    return _mixtures(s, d)[1]


@query("ML7b_gmm_labels")
def ml7b(s, d):
    return _mixtures(s, d)[0]


def _likelihood_sql(k: int) -> str:
    """The log-likelihood of the mixture whose components are the units by id % k."""
    return f"""(WITH f AS (SELECT *, (id % {k})::INT AS c FROM (SELECT *, count(*) OVER (PARTITION BY id) AS m FROM {_U}) WHERE m = 5), w AS (SELECT c, count(DISTINCT id) AS n FROM f GROUP BY c), p AS (SELECT c, feature, avg(value) AS mu, var_pop(value) + 1e-6 AS va FROM f GROUP BY ALL),
  l AS (SELECT f.id, p.c, sum(-0.5 * ((value - mu) ** 2 / va + ln(2 * pi() * va))) AS l FROM f JOIN p USING (feature) GROUP BY f.id, p.c), j AS (SELECT id, l + ln(n / (SELECT sum(n) FROM w)) AS l FROM l JOIN w USING (c)), t AS (SELECT id, max(l) AS top FROM j GROUP BY id),
  s AS (SELECT id, any_value(top) + ln(sum(exp(l - top))) AS ll FROM j JOIN t USING (id) GROUP BY id)
  SELECT {k} AS k, sum(ll) AS ll, count(*) AS n FROM s)"""


@query("ML7c_gmm_likelihood", f"""SELECT k, round(ll, 6) AS log_likelihood, round(2 * (k - 1 + 10 * k) - 2 * ll, 6) AS aic, round((k - 1 + 10 * k) * ln(n) - 2 * ll, 6) AS bic FROM (FROM {_likelihood_sql(2)} UNION ALL FROM {_likelihood_sql(3)})""")
def ml7c(s, d):
    """Likelihood and criteria of given components, before the first round."""
    points = staged(_points(units(s, d)), "unit-points")
    start = points.select("id", F.explode(F.array(F.lit(2), F.lit(3))).alias("k")).select("id", "k", (c("id") % c("k")).cast("int").alias("cluster"))
    return X.diagonal_mixture(points, start, rounds=0)[1].select("k", *(F.round(x, 6).alias(x) for x in ("log_likelihood", "aic", "bic")))


@query("ML8_graph_clusters")
def ml8(s, d):
    return M.graph_clusters(staged(M.pair_distances(M.standardise(units(s, d))), "unit-distances"), _ks(s, d))


@query("ML9_hierarchical")
def ml9(s, d):
    return M.hierarchical(_v(s, d), _ks(s, d))


_N = "(SELECT a.label, a.vec_id AS p, b.vec_id AS q FROM pts a JOIN pts b ON a.label = b.label AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 12.0)"


@query("ML10b_dbscan_points", f"""WITH n AS {_N}, k AS (SELECT p FROM n GROUP BY p HAVING count(*) >= 4) SELECT label, vec_id AS point, vec_id IN (SELECT p FROM k) AS is_core, vec_id NOT IN (SELECT p FROM k) AND vec_id NOT IN (SELECT p FROM n WHERE q IN (SELECT p FROM k)) AS is_noise FROM pts""")
def ml10b(s, d):
    return M.dbscan(pts(s, d), "label", "vec_id", 12.0, 4).select("label", "point", "is_core", c("cluster").isNull().alias("is_noise"))


@query("ML10_dbscan_grid", """WITH d AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM pts a JOIN pts b ON a.label = b.label AND a.vec_id <> b.vec_id),
e AS MATERIALIZED (SELECT unnest([10, 20, 30, 40, 50, 60, 70]) AS pct, unnest(quantile_cont(d, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7])) AS eps FROM d WHERE a < b), n AS MATERIALIZED (SELECT pct, a, b FROM d JOIN e ON d <= eps),
k AS MATERIALIZED (SELECT pct, least, a FROM (SELECT pct, a, count(*) + 1 AS n FROM n GROUP BY ALL), (SELECT unnest([2, 3, 4, 5]) AS least) WHERE n >= least),
c AS (SELECT pct, least, count(*) AS n_core FROM k GROUP BY ALL),
h AS (SELECT pct, least, count(*) AS n_held FROM (SELECT pct, least, a FROM k UNION SELECT pct, least, b FROM n JOIN k USING (pct, a)) GROUP BY ALL)
SELECT pct AS eps_percent, round(eps, 6) AS eps, s.least AS min_samples, coalesce(n_core, 0) AS n_core, round(1 - coalesce(n_held, 0) / (SELECT count(*) FROM pts), 6) AS noise_share FROM e CROSS JOIN (SELECT unnest([2, 3, 4, 5]) AS least) s LEFT JOIN c USING (pct, least) LEFT JOIN h USING (pct, least)""")
def ml10(s, d):
    return D.dbscan_grid(pts(s, d), "label", "vec_id").select("eps_percent", F.round("eps", 6).alias("eps"), "min_samples", "n_core", F.round("noise_share", 6).alias("noise_share"))


@query("ML10c_dbscan_clusters")
def ml10c(s, d):
    return D.dbscan_grid(pts(s, d), "label", "vec_id").select("eps_percent", "min_samples", "n_clusters")


_NEAR = "(SELECT a.vec_id AS p, b.vec_id AS q FROM embeddings a JOIN embeddings b ON list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= 1.12)"


@query("ML10d_dbscan_vectors", f"""WITH n AS MATERIALIZED {_NEAR}, k AS MATERIALIZED (SELECT p FROM n GROUP BY p HAVING count(*) >= 3), e AS (SELECT DISTINCT p FROM n WHERE q IN (SELECT p FROM k)) SELECT vec_id AS point, k.p IS NOT NULL AS is_core, k.p IS NULL AND e.p IS NULL AS is_noise FROM embeddings LEFT JOIN k ON k.p = vec_id LEFT JOIN e ON e.p = vec_id""")
def ml10d(s, d):
    """All dimensions of the vectors; exact, by tiles of all pairs."""
    found = D.dbscan_vectors(table(s, d, "embeddings"), "vec_id", "embedding", 1.12, 3)
    return found.select("point", "is_core", c("cluster").isNull().alias("is_noise"))


@query("ML11_cluster_validation", f"""WITH l AS {_L}, ds AS {_D.format(u=_U)}, m AS (SELECT a, x.cluster AS ca, y.cluster AS cb, avg(d) AS m FROM ds JOIN l x ON x.id = a JOIN l y ON y.id = b GROUP BY ALL), s AS (SELECT a, max(m) FILTER (ca = cb) AS own, min(m) FILTER (ca <> cb) AS oth FROM m GROUP BY a),
u AS (SELECT u.*, cluster FROM {_U} u JOIN l USING (id)), cen AS (SELECT cluster, feature, avg(value) AS c FROM u GROUP BY ALL), sp AS (SELECT cluster, avg(sqrt(q)) AS s, sum(q) AS w, count(*) AS n FROM (SELECT cluster, id, sum((value - c) ** 2) AS q FROM u JOIN cen USING (cluster, feature) GROUP BY ALL) GROUP BY cluster),
bt AS (SELECT cluster, sum((c - g) ** 2) AS b FROM cen JOIN (SELECT feature, avg(value) AS g FROM u GROUP BY feature) USING (feature) GROUP BY cluster), ap AS (SELECT x.cluster AS i, y.cluster AS j, sqrt(sum((x.c - y.c) ** 2)) AS m FROM cen x JOIN cen y ON x.feature = y.feature AND x.cluster <> y.cluster GROUP BY ALL)
SELECT (SELECT round(avg(CASE WHEN own IS NULL THEN 0 ELSE (oth - own) / greatest(own, oth) END), 6) FROM s) AS silhouette, (SELECT round(avg(r), 6) FROM (SELECT i, max((a.s + b.s) / m) AS r FROM ap JOIN sp a ON a.cluster = i JOIN sp b ON b.cluster = j GROUP BY i)) AS davies_bouldin, (SELECT round(sum(n * b) / (count(*) - 1) / (sum(w) / (sum(n) - count(*))), 6) FROM sp JOIN bt USING (cluster)) AS calinski_harabasz""")
def ml11(s, d):
    u, lab = units(s, d), _labels(s, d)
    both = M.silhouette(M.pair_distances(u), lab).join(F.broadcast(M.cluster_indices(u, lab)))
    return both.select(*(F.round(x, 6).alias(x) for x in ("silhouette", "davies_bouldin", "calinski_harabasz")))


@query("ML12_gap_statistic")
def ml12(s, d):
    return M.gap_statistic(M.standardise(units(s, d)), NAMES, _ks(s, d))


@query("ML13_rand_indices", f"""WITH j AS (SELECT id % 3 AS x, id % 2 AS y, count(*)::DOUBLE AS n FROM (SELECT DISTINCT id FROM {_U}) GROUP BY ALL), t AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM j) AS ij, (SELECT sum(n) FROM j) AS n, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM j GROUP BY x)) AS i, (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM j GROUP BY y)) AS k)
SELECT round((n * (n - 1) / 2 + 2 * ij - i - k) / (n * (n - 1) / 2), 6) AS rand, round((ij - i * k / (n * (n - 1) / 2)) / ((i + k) / 2 - i * k / (n * (n - 1) / 2)), 6) AS ari FROM t""")
def ml13(s, d):
    ids = units(s, d).select("id").distinct()
    r = M.rand_indices(ids.withColumn("cluster", c("id") % 3), ids.withColumn("cluster", c("id") % 2))
    return r.select(F.round("rand", 6).alias("rand"), F.round("ari", 6).alias("ari"))


_CUSTOMERS = """(SELECT c_custkey AS id, 'balance' AS method, least(4, floor((c_acctbal + 1000) / 2200))::INT AS cluster FROM customer UNION ALL SELECT c_custkey, 'region', n_regionkey::INT FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT c_custkey, 'segment', (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT FROM customer)"""


@query("ML13b_rand_table", f"""WITH l AS {_CUSTOMERS}, j AS (SELECT a.method AS method_a, b.method AS method_b, a.cluster AS x, b.cluster AS y, count(*)::DOUBLE AS n FROM l a JOIN l b ON a.id = b.id AND a.method < b.method GROUP BY ALL), s AS (SELECT method_a, method_b, sum(n * (n - 1) / 2) AS ij, sum(n) AS n FROM j GROUP BY ALL),
r AS (SELECT method_a, method_b, sum(m * (m - 1) / 2) AS i FROM (SELECT method_a, method_b, x, sum(n) AS m FROM j GROUP BY ALL) GROUP BY ALL), q AS (SELECT method_a, method_b, sum(m * (m - 1) / 2) AS k FROM (SELECT method_a, method_b, y, sum(n) AS m FROM j GROUP BY ALL) GROUP BY ALL), t AS (SELECT *, n * (n - 1) / 2 AS t FROM s JOIN r USING (method_a, method_b) JOIN q USING (method_a, method_b))
SELECT 5 AS k, method_a, method_b, n::BIGINT AS n, round((t + 2 * ij - i - k) / t, 6) AS rand, round((ij - i * k / t) / ((i + k) / 2 - i * k / t), 6) AS ari FROM t""")
def ml13b(s, d):
    """Three labelings of the customers by five classes each: region, market segment and fifths of the balance's range."""
    cust, nation = table(s, d, "customer"), table(s, d, "nation")
    names = cust.select("c_mktsegment").distinct().orderBy("c_mktsegment")
    rank = names.agg(F.array_sort(F.collect_list("c_mktsegment")).alias("names"))  # one row
    by = lambda df, method, cluster: df.select(c("c_custkey").alias("id"), F.lit(method).alias("method"), F.lit(5).alias("k"), cluster.cast("int").alias("cluster"))
    labels = by(cust, "balance", F.least(F.lit(4), F.floor((c("c_acctbal") + 1000) / 2200)))
    labels = labels.unionByName(by(cust.join(nation, c("c_nationkey") == c("n_nationkey")), "region", c("n_regionkey")))
    labels = labels.unionByName(by(cust.join(F.broadcast(rank)), "segment", F.array_position("names", c("c_mktsegment")) - 1))
    return M.rand_table(labels).select("k", "method_a", "method_b", "n", *(F.round(x, 6).alias(x) for x in ("rand", "ari")))


@query("ML13c_methods_agree")
def ml13c(s, d):
    """Every two clusterings of the units at equal k."""
    v, ks = _v(s, d), _ks(s, d)
    labels = M.kmeans(v, ks).unionByName(M.hierarchical(v, ks)).unionByName(_mixtures(s, d)[0])
    return M.rand_table(staged(labels, "unit-labels"))


@query("ML14_embedding_stability", f"""WITH d AS (SELECT a, b, round(d, 9) AS x FROM {_D.format(u=_U)} WHERE a < b), e AS (SELECT a, b, round(d, 9) AS y FROM {_D.format(u="(SELECT * FROM " + _U + " WHERE feature <> 'S4')")} WHERE a < b), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM d JOIN e USING (a, b))
SELECT count(*) AS n_pairs, round(corr(rx, ry), 6) AS spearman, CASE WHEN corr(rx, ry) >= 0.7 THEN 'STABLE' ELSE 'UNSTABLE' END AS status FROM r""")
def ml14(s, d):
    near = lambda t: M.pair_distances(t).withColumn("d", F.round("d", 9))
    return M.embedding_stability(near(units(s, d)), near(units(s, d).where("feature <> 'S4'"))).withColumn("spearman", F.round("spearman", 6))


_SEEDS, _TARGET = (1, 2, 3), 12
_SIGNS = ", ".join(f"({s}, {r}, {row})" for s in _SEEDS for r, row in enumerate(M.projection_signs(64, _TARGET, s)))


@query("ML14b_projection_stability", f"""WITH g(seed, r, signs) AS (VALUES {_SIGNS}), v AS MATERIALIZED (SELECT 0 AS seed, vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings UNION ALL SELECT seed, vec_id, list(list_inner_product(embedding::DOUBLE[], signs::DOUBLE[]) ORDER BY r) FROM embeddings, g GROUP BY seed, vec_id),
d AS (SELECT a.seed, a.id AS a, b.id AS b, round(list_distance(a.x, b.x), 9) AS d FROM v a JOIN v b ON a.seed = b.seed AND a.id < b.id), r AS MATERIALIZED (SELECT seed, a, b, rank() OVER (PARTITION BY seed ORDER BY d) + (count(*) OVER (PARTITION BY seed, d) - 1) / 2.0 AS r FROM d),
s AS (SELECT x.seed, count(*) AS n_pairs, corr(x.r, y.r) AS spearman FROM r x JOIN r y ON y.seed = 0 AND x.seed > 0 AND x.a = y.a AND x.b = y.b GROUP BY x.seed)
SELECT seed, n_pairs, round(spearman, 6) AS spearman, round(avg(spearman) OVER (), 6) AS mean_spearman, CASE WHEN avg(spearman) OVER () >= 0.7 THEN 'STABLE' ELSE 'UNSTABLE' END AS status FROM s""")
def ml14b(s, d):
    """Random projections of the vectors to 12 dimensions against the vectors, for three seeds."""
    points = table(s, d, "embeddings").select(c("vec_id").alias("id"), c("embedding").cast("array<double>").alias("x"))
    return M.projection_stability(points, 64, _TARGET, _SEEDS).withColumns({x: F.round(x, 6) for x in ("spearman", "mean_spearman")})


@query("ML15_complete_entry_view")
def ml15(s, d):
    return M.complete_entry_view(entries(s, d), NAMES)
