"""Exact quantiles by histogram refinement, sketches, mergeable bootstraps and diagonal mixtures against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierstats.operators import mixture, quantiles, resample

SHARES = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


@pytest.fixture(scope="module")
def groups(spark):
    rnd = random.Random(1)
    rows = [("hot", rnd.choice([1.0, 1.0, rnd.gauss(0, 1), 10 ** rnd.uniform(-20, 20), -(10 ** rnd.uniform(0, 9))])) for _ in range(3000)]
    rows += [("same", 7.0)] * 500 + [("few", 1.0), ("few", 2.0), (None, 5.0), (None, 8.0), ("none", None)] + [("ends", x) for x in (math.inf, -math.inf, 0.0, 1.0, 2.0, 3.0) * 20] + [("nan", x) for x in (math.nan, 1.0, 2.0) * 30]
    return spark.createDataFrame(rows, "g string, v double").repartition(4)


def numbers(df):
    return {r.g: (r.n, [repr(x) for x in r.q]) for r in df.collect()}


@pytest.mark.parametrize("bins", [64, 4096])
def test_refined_quantiles_are_those_of_percentile(groups, bins):
    plain = {r.g: (r.n, [repr(x) for x in r.q]) for r in groups.where("v is not null").groupBy("g").agg(F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, SHARES))).alias("q")).collect()}
    got = numbers(quantiles.quantiles(groups, ["g"], "v", SHARES, plain_values=60, bins=bins))
    assert got == plain and len(got) == 6
    whole = groups.where("g in ('hot', 'few')")
    want = whole.agg(F.percentile("v", F.array(*map(F.lit, SHARES))).alias("q")).first().q
    assert [r.q for r in quantiles.quantiles(whole, [], "v", SHARES, plain_values=60, bins=bins).collect()] == [want]
    assert quantiles.quantiles(groups.limit(0), ["g"], "v", SHARES).count() == 0


def test_sketches_are_near(groups):
    """The rank of a sketched quantile is near the one asked for, and its value is one of the group."""
    values = sorted(r.v for r in groups.where("g = 'hot'").collect())
    got = {r.g: (r.n, r.q) for r in quantiles.quantiles(groups.where("g in ('hot', 'few')"), ["g"], "v", SHARES, sketch=400).collect()}
    assert got["hot"][0] == 3000 and got["few"][0] == 2
    for p, x in zip(SHARES, got["hot"][1], strict=True):
        lo, hi = np.searchsorted(values, x, "left") / 3000, np.searchsorted(values, x, "right") / 3000
        assert x in values and lo - 0.03 <= p <= hi + 0.03


def test_weights_are_poisson():
    w = resample.weights(np.arange(4000), np.arange(500), 3)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    assert abs(np.corrcoef(w[:-1].ravel(), w[1:].ravel())[0, 1]) < 0.01 and abs(np.corrcoef(w[:, :-1].ravel(), w[:, 1:].ravel())[0, 1]) < 0.01
    assert (resample.weights(np.arange(100, 200), np.arange(7, 9), 3) == w[100:200, 7:9]).all()


def median_interval(values, replicates, seed):
    w = resample.weights(np.arange(len(values)), np.arange(replicates), seed)
    m = [np.median(np.repeat(values, w[:, b])) for b in range(replicates) if w[:, b].any()]
    return tuple(np.quantile(m, [0.025, 0.975])) if m else (None, None)


@pytest.mark.parametrize(("plain", "part"), [(1_000_000, 1 << 18), (0, 40)])
def test_mergeable_bootstrap(spark, plain, part):
    """Whole tests and tests cut into ranges give the interval of the same weights."""
    rnd = random.Random(2)
    rows = [("a", i, round(rnd.gauss(0, 1), 1)) for i in range(300)] + [("b", i, rnd.random()) for i in range(5)] + [("c", 0, 2.5), ("a", 900, None), ("d", 1, None)]
    df = spark.createDataFrame(rows, "t string, k int, v double").repartition(3)
    got = {r.t: (r.n, r.ci_low, r.ci_high) for r in resample.mergeable_bootstrap(df, ["t"], ["k"], "v", 300, 5, plain, part).collect()}
    for t in "abc":
        v = np.array([x for x, _ in sorted((x, k) for u, k, x in rows if u == t and x is not None)])
        assert got[t] == pytest.approx((len(v), *median_interval(v, 300, 5)))
    assert set(got) == set("abc")
    every = resample.mergeable_bootstrap(df.where("t = 'a'"), [], ["k"], "v", 300, 5, plain, part).collect()
    assert [(r.ci_low, r.ci_high) for r in every] == [got["a"][1:]]


def test_bootstrap_covers(spark):
    """Over many samples the interval holds the true median about as often as it says."""
    rng = np.random.default_rng(4)
    rows = [(t, i, float(x)) for t in range(150) for i, x in enumerate(rng.normal(size=60))]
    out = resample.mergeable_bootstrap(spark.createDataFrame(rows, "t int, k int, v double"), ["t"], ["k"], "v", 400).collect()
    assert 0.88 <= sum(r.ci_low <= 0 <= r.ci_high for r in out) / 150 <= 1.0


def log_likelihood(x, parameters):
    parts = [math.log(p.weight) - 0.5 * sum((x - np.array(p["mean"])).T ** 2 / np.array(p.variance)[:, None] + np.log(2 * np.pi * np.array(p.variance))[:, None]) for p in parameters]
    top = np.max(parts, axis=0)
    return float((top + np.log(np.exp(np.array(parts) - top).sum(0))).sum())


def test_mixtures(spark):
    """Likelihood, criteria and labels from the parameters; planted groups of different spread are found; more rounds fit better."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0, [1, 0.2, 1], (120, 3)), rng.normal(6, [0.3, 2, 1], (80, 3)), np.full((5, 3), 20.0)])
    points = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    start = mixture.start_labels(points, [2, 3, 4])
    labels, scores, parameters = mixture.diagonal_mixture(points, start)
    by, own = {r.k: r for r in scores.collect()}, parameters.collect()
    for k, s in by.items():
        assert s.log_likelihood == pytest.approx(log_likelihood(x, [p for p in own if p.k == k]))
        free = k - 1 + 2 * k * 3
        assert (s.aic, s.bic) == pytest.approx((2 * free - 2 * s.log_likelihood, free * math.log(205) - 2 * s.log_likelihood)) and 0 < s.rounds < 100
        assert sum(p.weight for p in own if p.k == k) == pytest.approx(1)
    assert min(by.values(), key=lambda s: s.bic).k == 3
    got = {r.id: r.cluster for r in labels.where("k = 3").collect()}
    assert [len({got[i] for i in part}) for part in (range(120), range(120, 200), range(200, 205))] == [1, 1, 1] and len(set(got.values())) == 3
    early = {r.k: r.log_likelihood for r in mixture.diagonal_mixture(points, start, rounds=1)[1].collect()}
    assert all(by[k].log_likelihood >= early[k] - 1e-6 for k in by)


def test_values_are_counted_once_for_all_ranks_of_a_group(spark, monkeypatch):
    """Three quartiles want up to six ranks; no row is made for each of them, and many groups are not sent to the tasks."""
    from tierstats.operators import quantiles as Q

    df = spark.createDataFrame([(g if g else None, float(i * 7919 % 1009)) for g in range(5) for i in range(40)], "k int, v double")
    want = {r["k"]: r["q"] for r in df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q")).collect()}
    seen = []
    keep = Q.staged
    monkeypatch.setattr(Q, "staged", lambda d, name: seen.append((name, t := keep(d, name))) or t)
    for most in (100_000, 0):
        seen.clear()
        monkeypatch.setattr(Q, "MOST_SENT", most)
        monkeypatch.setattr(Q.selected, "__defaults__", (*Q.selected.__defaults__[:2], most))
        monkeypatch.setattr(Q, "discard", lambda *_: None)
        got = {r["k"]: r["q"] for r in Q.quantiles(df, ["k"], "v", (0.25, 0.5, 0.75), 10, 16).collect()}
        assert got == want
        assert [t for n, t in seen if n == "quantile-todo"][0].count() == 5  # a row a group in the first round


def test_a_round_of_mixtures_writes_a_row_a_component(spark, monkeypatch):
    from tierstats.operators import mixture

    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(4 * (i % 2), 1), rnd.gauss(0, 1)]) for i in range(200)]
    points = spark.createDataFrame(rows, "id long, x array<double>")
    start = spark.createDataFrame([(i, k, i % k) for i, _ in rows for k in (2, 3)], "id long, k int, cluster int")
    write, sizes = mixture.staged, []
    monkeypatch.setattr(mixture, "staged", lambda t, name: (out := write(t, name), sizes.append((name, out.count())))[0])
    assert mixture.diagonal_mixture(points, start, rounds=2)[0].count() == 400
    rounds = [n for name, n in sizes if name == "mixture-round"]
    assert rounds and max(rounds) <= 5
