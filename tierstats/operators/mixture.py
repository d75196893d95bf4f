"""Diagonal Gaussian mixtures of several sizes at once, by expectation-maximisation.

A round is one pass over the points and one aggregate: posteriors of all components of all mixtures are made in the row, by
log-sum-exp, and only their sums are shuffled. What is broadcast are the parameters, a row for each component.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import log, pi

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierstats.sources.shared import discard, staged

#: Added to every variance, so that a component of equal points has a density.
LEAST_VARIANCE = 1e-6


def _parameters(sums: DataFrame, dims: int) -> DataFrame:
    """(k, cluster, weight, mean, variance) from (k, cluster, r, s, q): sums of the posteriors, and of them times x and x squared."""
    mean = F.array(*(F.col("s")[i] / F.col("r") for i in range(dims)))
    variance = F.array(*(F.greatest(F.col("q")[i] / F.col("r") - (F.col("s")[i] / F.col("r")) ** 2, F.lit(0.0)) + LEAST_VARIANCE for i in range(dims)))
    total = F.col("all")
    return sums.select("k", "cluster", (F.col("r") / total).alias("weight"), mean.alias("mean"), variance.alias("variance"))


def _sums(each: DataFrame, dims: int) -> DataFrame:
    """each (k, cluster, x, p) -> the sums of each component, and the number of points of its mixture."""
    of = lambda f: F.array(*(F.sum(F.col("p") * f(F.col("x")[i])) for i in range(dims)))
    g = each.groupBy("k", "cluster").agg(F.sum("p").alias("r"), of(lambda x: x).alias("s"), of(lambda x: x * x).alias("q"))
    return g.where("r > 1e-12")


def _round(each: DataFrame, dims: int) -> DataFrame:
    """``densities`` -> the sums of each component, also of those without weight, with ``ll``: they add up to the log-likelihood of the mixture."""
    parts = each.select("k", "x", "ll", F.posexplode("parts").alias("at", "o")).select("k", "x", "o.cluster", "o.p", F.when(F.col("at") == 0, F.col("ll")).alias("ll"))
    of = lambda f: F.array(*(F.sum(F.col("p") * f(F.col("x")[i])) for i in range(dims)))
    return parts.groupBy("k", "cluster").agg(F.sum("p").alias("r"), of(lambda x: x).alias("s"), of(lambda x: x * x).alias("q"), F.sum("ll").alias("ll"))


def densities(points: DataFrame, parameters: DataFrame) -> DataFrame:
    """points (id, x) -> (id, x, k, ll, parts): for every mixture the log density, and (cluster, p): each component's posterior."""
    one = F.expr("log(weight) - 0.5D * aggregate(variance, 0D, (t, v) -> t + log(v))").alias("c")
    by_k = parameters.select("k", "cluster", one, "mean", "variance").groupBy("k").agg(F.collect_list(F.struct("cluster", "c", "mean", "variance")).alias("parts"))
    j = points.join(F.broadcast(by_k))  # a row a mixture: the sizes asked for
    far = "aggregate(zip_with(zip_with(x, o.mean, (a, m) -> (a - m) * (a - m)), o.variance, (d, v) -> d / v), 0D, (t, e) -> t + e)"
    j = j.withColumn("logs", F.expr(f"transform(parts, o -> struct(o.cluster AS cluster, o.c - 0.5D * {far} - 0.5D * size(x) * {log(2 * pi)!r}D AS l))"))
    j = j.withColumn("top", F.expr("array_max(transform(logs, o -> o.l))"))
    j = j.withColumn("ll", F.expr("top + log(aggregate(logs, 0D, (t, o) -> t + exp(o.l - top)))"))
    return j.select("id", "x", "k", "ll", F.expr("transform(logs, o -> struct(o.cluster AS cluster, exp(o.l - ll) AS p))").alias("parts"))


def diagonal_mixture(points: DataFrame, start: DataFrame, rounds: int = 100, tolerance: float = 1e-3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """points (id, x array), start (id, k, cluster), labels to begin with for every size k -> (labels, scores, parameters).

    labels (id, method, k, cluster): the most probable component, ties to the smaller. scores (k, log_likelihood, aic, bic, rounds): a
    mixture of k components in d dimensions has k - 1 + 2 k d free parameters. parameters (k, cluster, weight, mean,
    variance). A mixture is settled when its log-likelihood gains less than ``tolerance`` a point in a round; rounds go on
    until all are, at most ``rounds`` times, and settled ones stay as they are. A component that loses all its weight is gone.
    """
    spark = points.sparkSession
    points = staged(points.select("id", "x"), "mixture-points")
    n, dims = points.count(), len(points.first()["x"])
    first = points.join(start.select("id", "k", "cluster").hint("merge"), "id").withColumn("p", F.lit(1.0))
    now = staged(_parameters(_sums(first, dims).withColumn("all", F.lit(float(n))), dims), "mixture-parameters")
    last: dict[int, float] = {}
    done: dict[int, tuple[float, int]] = {}
    for i in range(rounds + 1):
        open_ = now.where(~F.col("k").isin(list(done)))
        each = staged(_round(densities(points, open_).select("k", "x", "ll", "parts"), dims), "mixture-round")  # a row a component
        score = {r["k"]: r["ll"] for r in each.groupBy("k").agg(F.sum("ll").alias("ll")).collect()}  # a row a mixture
        for k, ll in score.items():
            if i == rounds or k in last and ll - last[k] < tolerance * n:
                done[k] = (ll, i)
        last = score
        if len(done) == len(score) + len(set(done) - set(score)):
            discard(spark, each)
            break
        moved = each.where(~F.col("k").isin(list(done)) & (F.col("r") > 1e-12))
        after = _parameters(moved.withColumn("all", F.lit(float(n))), dims)
        after = staged(after.unionByName(now.where(F.col("k").isin(list(done)))), "mixture-parameters")
        discard(spark, each)
        discard(spark, now)
        now = after
    best = F.expr("array_max(transform(parts, o -> struct(o.p AS p, -o.cluster AS c)))")
    labels = densities(points, now).select("id", F.lit("mixture").alias("method"), "k", (-best["c"]).alias("cluster"))
    free = lambda k: k - 1 + 2 * k * dims
    scores = [(k, ll, 2.0 * free(k) - 2 * ll, free(k) * log(n) - 2 * ll, i) for k, (ll, i) in sorted(done.items())]
    return labels, spark.createDataFrame(scores, "k int, log_likelihood double, aic double, bic double, rounds int"), now


def start_labels(points: DataFrame, ks: Sequence[int], seed: int = 42) -> DataFrame:
    """k-means labels of the points (id, x) for each k, as a start."""
    from .matrix import grouped_kmeans

    return grouped_kmeans(points.select(F.lit(0).alias("ref"), "id", "x"), ks, seed).select("id", "k", "cluster")
