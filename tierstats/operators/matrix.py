"""Matrix preparation, components, clusters and their validation, on the long form (id, feature, value).

The matrices are unit-level results (tens to thousands of rows); operators that pair rows say so. Absent cells are
absent rows, never zeros.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tierstats.sources.shared import staged

from .density import dbscan_points
from .pairranks import distance_rank_correlations
from .windows import avg_rank

LONG = ["id", "feature", "value"]


def grid(long: DataFrame, cohort: DataFrame) -> DataFrame:
    """Every id of the cohort with every feature; the cohort's own observed values."""
    names = long.select("feature").distinct()
    return cohort.select("id").distinct().join(F.broadcast(names)).join(long, ["id", "feature"], "left")  # features are columns: few


def impute_median(long: DataFrame, cohort: DataFrame) -> DataFrame:
    """Missing cells get the median of the cohort's observed values; ``imputed`` marks them."""
    g = grid(long, cohort)
    m = g.groupBy(F.col("feature").alias("_f")).agg(F.median("value").alias("_m"))
    j = g.join(m, F.col("feature") == F.col("_f"))
    return j.select("id", "feature", F.coalesce("value", "_m").alias("value"), F.col("value").isNull().alias("imputed"))


def pair_distances(long: DataFrame, scale_missing: bool = False) -> DataFrame:
    """(a, b, d) of all ordered pairs of ids, over the features that both have. Each pair is a row of the result, so it is meant for
    matrices of units; ``density`` has neighbours without pairs.

    scale_missing: squared distances are scaled up by features / common features."""
    n = long.select("feature").distinct().count()
    a, b = long.select(F.col("id").alias("a"), "feature", F.col("value").alias("_x")), long.select(F.col("id").alias("b"), "feature", F.col("value").alias("_y"))
    g = a.join(b.hint("merge"), "feature").where("a <> b").groupBy("a", "b").agg(F.sum((F.col("_x") - F.col("_y")) ** 2).alias("_s"), F.count(F.lit(1)).alias("_n"))
    return g.select("a", "b", F.sqrt(F.col("_s") * (F.lit(float(n)) / F.col("_n")) if scale_missing else F.col("_s")).alias("d"))


def impute_knn(long: DataFrame, cohort: DataFrame, k: int = 5) -> DataFrame:
    """Missing cells get the mean of the k nearest rows that have the value, weighted by 1 / distance."""
    g = grid(long, cohort)
    own = g.where(F.col("value").isNotNull())
    d = pair_distances(own, scale_missing=True)
    gap = g.where(F.col("value").isNull()).select(F.col("id").alias("a"), "feature")
    donors = gap.join(d, "a").join(own.select(F.col("id").alias("b"), "feature", "value"), ["b", "feature"])
    near = donors.withColumn("_r", F.row_number().over(W.partitionBy("a", "feature").orderBy("d", "b"))).where(F.col("_r") <= k)
    exact = F.count(F.when(F.col("d") == 0, 1))
    weight = F.when(F.col("d") > 0, 1 / F.col("d"))
    filled = near.groupBy("a", "feature").agg(F.when(exact > 0, F.avg(F.when(F.col("d") == 0, F.col("value")))).otherwise(F.sum(weight * F.col("value")) / F.sum(weight)).alias("value"))
    rest = filled.select(F.col("a").alias("id"), "feature", "value", F.lit(True).alias("imputed"))
    return own.select("id", "feature", "value", F.lit(False).alias("imputed")).unionByName(rest)


def complete_case(long: DataFrame, features: Sequence[str], least: int = 10) -> tuple[DataFrame, DataFrame]:
    """Rows that have all features, and one row (n_complete, status)."""
    have = long.where(F.col("feature").isin(*features)).groupBy("id").agg(F.count_distinct("feature").alias("n")).where(F.col("n") == len(features)).select("id")
    status = have.agg(F.count(F.lit(1)).alias("n_complete")).withColumn("status", F.when(F.col("n_complete") >= least, "ADEQUATE").otherwise("TOO_FEW"))
    return long.join(have, "id", "left_semi"), status


def standardise(long: DataFrame) -> DataFrame:
    """Mean 0 and population SD 1 by feature; a constant feature becomes 0."""
    s = long.groupBy(F.col("feature").alias("_f")).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    z = (F.col("value") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    return long.join(s, F.col("feature") == F.col("_f")).select("id", "feature", z.alias("value"))


def vectors(long: DataFrame, features: Sequence[str]) -> DataFrame:
    """(id, features) with a dense vector; rows that lack a feature are left out."""
    from pyspark.ml.functions import array_to_vector

    wide = long.groupBy("id").pivot("feature", list(features)).agg(F.max("value")).dropna(subset=list(features))
    return wide.select("id", array_to_vector(F.array(*features)).alias("features"))


def pca(long: DataFrame, features: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ratios, scores, loadings) of all components on centred data; signs make the largest absolute loading positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    spark, k = long.sparkSession, len(features)
    m = long.groupBy(F.col("feature").alias("_f")).agg(F.avg("value").alias("_m"))
    centred = long.join(m, F.col("feature") == F.col("_f")).select("id", "feature", (F.col("value") - F.col("_m")).alias("value"))
    v = staged(vectors(centred, features), "pca-rows")  # the fit passes over them more than once, the scores once more
    model = PCA(k=k, inputCol="features", outputCol="scores").fit(v)
    axes = model.pc.toArray()  # features x components: a model, not data
    sign = [1.0 if axes[abs(axes[:, c]).argmax(), c] >= 0 else -1.0 for c in range(k)]
    ratios = spark.createDataFrame([(c + 1, float(x)) for c, x in enumerate(model.explainedVariance.toArray())], "component int, ratio double")
    loadings = spark.createDataFrame([(features[f], c + 1, float(axes[f, c] * sign[c])) for f in range(k) for c in range(k)], "feature string, component int, loading double")
    s = model.transform(v).select("id", F.posexplode(vector_to_array("scores")).alias("_c", "_x"))
    flip = F.get(F.array(*(F.lit(x) for x in sign)), F.col("_c"))
    return ratios, s.select("id", (F.col("_c") + 1).alias("component"), (F.col("_x") * flip).alias("score")), loadings


def _labels(model, v: DataFrame, k: int, method: str) -> DataFrame:
    return model.transform(v).select("id", F.lit(method).alias("method"), F.lit(k).alias("k"), F.col("prediction").alias("cluster"))


def kmeans(v: DataFrame, ks: Sequence[int], seed: int = 42) -> DataFrame:
    from pyspark.ml.clustering import KMeans

    return _union([_labels(KMeans(k=k, seed=seed).fit(v), v, k, "kmeans") for k in ks])


def hierarchical(v: DataFrame, ks: Sequence[int], seed: int = 42) -> DataFrame:
    """Bisecting k-means: a divisive tree on the variance criterion; its labels are not those of Ward's method."""
    from pyspark.ml.clustering import BisectingKMeans

    return _union([_labels(BisectingKMeans(k=k, seed=seed).fit(v), v, k, "bisecting") for k in ks])


def graph_clusters(distances: DataFrame, ks: Sequence[int], neighbours: int = 5) -> DataFrame:
    """Power iteration clustering of the nearest-neighbour graph; ids must be whole numbers."""
    from pyspark.ml.clustering import PowerIterationClustering

    near = distances.withColumn("_r", F.row_number().over(W.partitionBy("a").orderBy("d", "b"))).where(F.col("_r") <= neighbours)
    edges = near.select(F.least("a", "b").cast("long").alias("src"), F.greatest("a", "b").cast("long").alias("dst")).distinct().withColumn("weight", F.lit(1.0))
    out = [PowerIterationClustering(k=k, srcCol="src", dstCol="dst", weightCol="weight").assignClusters(edges).select("id", F.lit("graph").alias("method"), F.lit(k).alias("k"), "cluster") for k in ks]
    return _union(out)


def _union(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def dbscan(points: DataFrame, group: str, point_id: str, eps: float, least: int) -> DataFrame:
    """(group, point, is_core, cluster) of 3-D points x, y, z: clusters are components of core points within eps, named by
    their smallest id; border points go to the smallest core in reach; noise has a null cluster. By tiles of points."""
    return dbscan_points(points, group, point_id, eps, least)


def silhouette(distances: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: mean Euclidean silhouette from pairwise distances; a row alone in its cluster counts 0."""
    a = labels.select(F.col("id").alias("a"), F.col("cluster").alias("ca"))
    b = labels.select(F.col("id").alias("b"), F.col("cluster").alias("cb"))
    m = distances.join(a.hint("merge"), "a").join(b.hint("merge"), "b").groupBy("a", "ca", "cb").agg(F.avg("d").alias("m"))
    g = m.groupBy("a").agg(F.max(F.when(F.col("ca") == F.col("cb"), F.col("m"))).alias("own"), F.min(F.when(F.col("ca") != F.col("cb"), F.col("m"))).alias("other"))
    return g.agg(F.avg(F.when(F.col("own").isNull(), 0.0).otherwise((F.col("other") - F.col("own")) / F.greatest("own", "other"))).alias("silhouette"))


def cluster_indices(long: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: Davies-Bouldin and Calinski-Harabasz from centroids and sums."""
    j = long.join(labels.select("id", "cluster"), "id")
    cen = j.groupBy("cluster", "feature").agg(F.avg("value").alias("_c"))
    mean = j.groupBy("feature").agg(F.avg("value").alias("_g"))
    size = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    d = j.join(cen, ["cluster", "feature"]).groupBy("cluster", "id").agg(F.sum((F.col("value") - F.col("_c")) ** 2).alias("_d"))
    spread = d.groupBy("cluster").agg(F.avg(F.sqrt("_d")).alias("s"), F.sum("_d").alias("w"))
    between = cen.join(mean, "feature").groupBy("cluster").agg(F.sum((F.col("_c") - F.col("_g")) ** 2).alias("b")).join(size, "cluster")
    x, y = cen.select(F.col("cluster").alias("i"), "feature", F.col("_c").alias("_x")), cen.select(F.col("cluster").alias("j"), "feature", F.col("_c").alias("_y"))
    apart = x.join(y, "feature").where("i <> j").groupBy("i", "j").agg(F.sqrt(F.sum((F.col("_x") - F.col("_y")) ** 2)).alias("m"))
    si, sj = spread.select(F.col("cluster").alias("i"), F.col("s").alias("si")), spread.select(F.col("cluster").alias("j"), F.col("s").alias("sj"))
    db = apart.join(si, "i").join(sj, "j").groupBy("i").agg(F.max((F.col("si") + F.col("sj")) / F.col("m")).alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    t = between.agg(F.sum(F.col("n") * F.col("b")).alias("B"), F.sum("n").alias("N"), F.count(F.lit(1)).alias("K")).join(F.broadcast(spread.agg(F.sum("w").alias("Wn"))))
    ch = t.select((F.col("B") / (F.col("K") - 1) / (F.col("Wn") / (F.col("N") - F.col("K")))).alias("calinski_harabasz"))
    return db.join(F.broadcast(ch))  # one row each


def _squared(x: str, y: str) -> str:
    """SQL of the squared distance of two arrays."""
    return f"aggregate(zip_with({x}, {y}, (p, q) -> (p - q) * (p - q)), 0D, (t, e) -> t + e)"


def grouped_kmeans(points: DataFrame, ks: Sequence[int], seed: int = 42, restarts: int = 3, rounds: int = 300) -> DataFrame:
    """points (ref, id, x array) -> (ref, id, x, k, cluster): Lloyd's k-means of each ref and k side by side, the best of
    ``restarts`` starts. Each round is one pass over the points and one aggregate; what is broadcast are the centres,
    refs x restarts x the sum of ks of them. Rounds end when no assignment cost changes; k-means settles after finitely many, and
    not having settled after ``rounds`` is an error."""
    spark, dims = points.sparkSession, range(len(points.first()["x"]))
    points = staged(points.select("ref", "id", "x"), "kmeans-points")
    tries = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(t).alias("try")) for k in ks for t in range(restarts)))
    each = points.select("ref", "id", "x", F.explode(tries).alias("t")).select("ref", "id", "x", "t.*")
    order = F.row_number().over(W.partitionBy("ref", "k", "try").orderBy(F.xxhash64(F.lit(seed), "ref", "k", "try", "id"), "id"))
    centres = staged(each.withColumn("cluster", order).where("cluster <= k").select("ref", "k", "try", "cluster", "x"), "kmeans-centres")
    cost, last = None, None
    for _ in range(rounds):
        by_try = centres.groupBy("ref", "k", "try").agg(F.collect_list(F.struct("cluster", "x")).alias("c"))
        by_ref = by_try.groupBy("ref").agg(F.collect_list(F.struct("k", "try", "c")).alias("tries"))
        near = F.expr(f"array_min(transform(t.c, o -> struct({_squared('o.x', 'x')} AS d, o.cluster AS cluster)))")
        at = points.join(F.broadcast(by_ref), "ref").select("ref", "id", "x", F.explode("tries").alias("t")).select("ref", "id", "x", "t.k", "t.try", near.alias("n")).select("ref", "id", "x", "k", "try", "n.d", "n.cluster")
        means = F.array(*(F.avg(F.col("x")[i]) for i in dims))
        moved = staged(at.groupBy("ref", "k", "try", "cluster").agg(means.alias("x"), F.sum("d").alias("d")), "kmeans-centres")
        now = round(moved.agg(F.sum("d")).first()[0], 9)
        last, cost, centres, settled = at, now, moved.select("ref", "k", "try", "cluster", "x"), now == cost
        if settled:
            break
    else:
        raise RuntimeError(f"k-means has not settled in {rounds} rounds")
    best = moved.groupBy("ref", "k", "try").agg(F.sum("d").alias("d")).groupBy("ref", "k").agg(F.min_by("try", F.struct("d", "try")).alias("try"))
    return last.join(F.broadcast(staged(best, "kmeans-best")), ["ref", "k", "try"]).select("ref", "id", "x", "k", "cluster")


def gap_statistic(long: DataFrame, features: Sequence[str], ks: Sequence[int], references: int = 20, seed: int = 42) -> DataFrame:
    """(k, gap, s, chosen): log dispersion against uniform references in the bounding box; chosen is the smallest k whose gap is
    at least the next one's less its s. All references and ks are clustered side by side; within clusters rows are paired."""
    cell = lambda f: F.max(F.when(F.col("feature") == f, F.col("value")))
    own = long.groupBy("id").agg(F.array(*(cell(f) for f in features)).alias("x")).where(F.forall("x", F.isnotnull))
    lo, hi = (F.array(*(agg(F.col("x")[i]) for i in range(len(features)))) for agg in (F.min, F.max))
    box = own.agg(lo.alias("lo"), hi.alias("hi"))  # one row
    unit = lambda i: F.pmod(F.xxhash64(F.lit(seed), "ref", "id", F.lit(i)), F.lit((1 << 31) - 1)) / float((1 << 31) - 1)
    drawn = own.select("id", F.explode(F.sequence(F.lit(1), F.lit(references))).alias("ref")).join(F.broadcast(box))
    drawn = drawn.select("ref", "id", F.array(*(F.col("lo")[i] + (F.col("hi")[i] - F.col("lo")[i]) * unit(i) for i in range(len(features)))).alias("x"))
    labels = staged(grouped_kmeans(own.select(F.lit(0).alias("ref"), "id", "x").unionByName(drawn), ks, seed), "gap-labels")
    size = labels.groupBy("ref", "k", "cluster").agg(F.count(F.lit(1)).alias("n"))
    other = labels.select("ref", "k", "cluster", F.col("id").alias("b"), F.col("x").alias("y"))
    apart = labels.join(other.hint("merge"), ["ref", "k", "cluster"]).where("id < b").groupBy("ref", "k", "cluster").agg(F.sum(F.sqrt(F.expr(_squared("x", "y")))).alias("s"))
    w = size.join(apart, ["ref", "k", "cluster"], "left").groupBy("ref", "k").agg(F.sum(F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("w"))
    logs = w.withColumn("l", F.log(F.greatest("w", F.lit(1e-300))))
    g = logs.groupBy("k").agg(F.avg(F.when(F.col("ref") > 0, F.col("l"))).alias("m"), F.stddev_pop(F.when(F.col("ref") > 0, F.col("l"))).alias("sd"), F.max(F.when(F.col("ref") == 0, F.col("l"))).alias("own"))
    g = g.select("k", (F.col("m") - F.col("own")).alias("gap"), (F.col("sd") * (1 + 1 / references) ** 0.5).alias("s"))
    one = W.partitionBy(F.lit(0))  # one row a k
    good = F.col("gap") >= F.lead(F.col("gap") - F.col("s")).over(one.orderBy("k"))
    return g.withColumn("good", good).withColumn("chosen", F.col("good") & (F.col("k") == F.min(F.when(F.col("good"), F.col("k"))).over(one))).select("k", "gap", "s", F.coalesce("chosen", F.lit(False)).alias("chosen"))


def rand_indices(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: Rand and adjusted Rand index of two labelings (id, cluster), from the contingency table."""
    j = a.select("id", F.col("cluster").alias("x")).join(b.select("id", F.col("cluster").alias("y")), "id").groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    both = j.agg(pairs(F.col("n")).alias("ij"), F.sum("n").alias("n"))
    rows = j.groupBy("x").agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("i"))
    cols = j.groupBy("y").agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("j"))
    t = both.join(F.broadcast(rows)).join(F.broadcast(cols))  # one row each
    total = F.col("n") * (F.col("n") - 1) / 2
    expected = F.col("i") * F.col("j") / total
    ari = (F.col("ij") - expected) / F.when((F.col("i") + F.col("j")) / 2 != expected, (F.col("i") + F.col("j")) / 2 - expected)
    return t.select(((total + 2 * F.col("ij") - F.col("i") - F.col("j")) / total).alias("rand"), F.coalesce(ari, F.lit(1.0)).alias("ari"))


def rand_table(labels: DataFrame) -> DataFrame:
    """labels (id, method, k, cluster) -> (k, method_a, method_b, n, rand, ari): both indices of every two methods at equal k, over the ids
    that both label, from their contingency tables."""
    by = ["k", "method_a", "method_b"]
    each = labels.where("id IS NOT NULL AND k IS NOT NULL").groupBy("id", "k").agg(F.collect_list(F.struct("method", "cluster")).alias("l"))  # a label a method
    two = F.expr("flatten(transform(l, a -> transform(filter(l, b -> a.method < b.method), b -> struct(a.method AS method_a, b.method AS method_b, a.cluster AS x, b.cluster AS y))))")
    j = each.select("k", F.explode(two).alias("p")).select("k", "p.*").groupBy(*by, "x", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = lambda: F.sum(F.col("n") * (F.col("n") - 1) / 2)
    rows = j.groupBy(*by, "x").agg(F.sum("n").alias("n")).groupBy(*by).agg(pairs().alias("i"))
    cols = j.groupBy(*by, "y").agg(F.sum("n").alias("n")).groupBy(*by).agg(pairs().alias("j"))
    t = j.groupBy(*by).agg(pairs().alias("ij"), F.sum("n").alias("n")).join(rows.hint("merge"), by).join(cols.hint("merge"), by)
    total = F.col("n") * (F.col("n") - 1) / 2
    expected = F.col("i") * F.col("j") / total
    middle = (F.col("i") + F.col("j")) / 2
    ari = (F.col("ij") - expected) / F.when(middle != expected, middle - expected)
    return t.select(*by, F.col("n").cast("long").alias("n"), ((total + 2 * F.col("ij") - F.col("i") - F.col("j")) / total).alias("rand"), F.coalesce(ari, F.lit(1.0)).alias("ari"))


def embedding_stability(first: DataFrame, second: DataFrame, level: float = 0.7) -> DataFrame:
    """One row: Spearman correlation of the pairwise distances (a, b, d) of two embeddings, STABLE from ``level`` up."""
    j = first.where("a < b").select("a", "b", F.col("d").alias("x")).join(second.where("a < b").select("a", "b", F.col("d").alias("y")).hint("merge"), ["a", "b"]).withColumn("_t", F.lit(1))
    r = avg_rank(avg_rank(j, ["_t"], "x", "rx"), ["_t"], "y", "ry")
    return r.agg(F.count(F.lit(1)).alias("n_pairs"), F.corr("rx", "ry").alias("spearman")).withColumn("status", F.when(F.col("spearman") >= level, "STABLE").otherwise("UNSTABLE"))


def projection_signs(dims: int, target: int, seed: int) -> list[list[int]]:
    """Of a seed's random projection to ``target`` dimensions, the sign of each step: rows are the steps, columns the dimensions."""
    import numpy as np

    from .resample import mixed

    at = np.arange(target * dims, dtype=np.uint32) + np.uint32(seed * 1_000_003)
    return (1 - 2 * (mixed(mixed(at)) >> np.uint32(31)).astype(int)).reshape(target, dims).tolist()


def projection_stability(points: DataFrame, dims: int, target: int, seeds: Sequence[int], level: float = 0.7) -> DataFrame:
    """points (id, x: array of ``dims`` numbers) -> (seed, n_pairs, spearman, mean_spearman, status): random projections against the points
    themselves. For each seed, the rank correlation of the distances of all pairs before and after; STABLE if the mean over the
    seeds is ``level`` or more. Exact, by tiles and bins of packed distances: no pair becomes a row."""
    import numpy as np

    found = distance_rank_correlations(points, dims, [np.array(projection_signs(dims, target, s)).T for s in seeds])
    by = found.select(F.get(F.array(*map(F.lit, seeds)), F.col("view")).alias("seed"), "n_pairs", "spearman")
    mean = by.agg(F.avg("spearman").alias("mean_spearman"))  # one row
    return by.join(F.broadcast(mean)).withColumn("status", F.when(F.col("mean_spearman") >= level, "STABLE").otherwise("UNSTABLE"))


def complete_entry_view(long: DataFrame, features: Sequence[str]) -> DataFrame:
    """First two components of the standardised rows that have all features."""
    full, _ = complete_case(long, features)
    full = staged(standardise(full.where(F.col("feature").isin(*features))), "complete-rows")
    _, scores, _ = pca(full, features)
    return scores.where("component <= 2")
