"""Ordered operations cut into range partitions against uncut ones, and leave-one-out against plain folds."""

import math
import random
import statistics
from collections import defaultdict

import pytest

from tierstats.functions.exact import chi2_tail, wilcoxon_p
from tierstats.operators import loo, ordered, windows


@pytest.fixture
def cut(monkeypatch):
    """Range partitions of five rows."""
    monkeypatch.setattr(ordered.Ordered.__init__, "__defaults__", (ordered.PLAIN_ROWS, 5))
    return 0


def got(df, places=9):
    return sorted((tuple(round(x, places) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def tests(spark):
    rnd = random.Random(4)
    rows = [("hot", i, round(rnd.random() ** 3, 2)) for i in range(40)] + [("b", i, rnd.random()) for i in range(3)] + [("c", 0, 0.5), ("hot", 99, None), ("d", 1, None), (None, 1, 0.2), (None, 2, 0.2)]
    return rows, spark.createDataFrame(rows, "f string, k int, p double").repartition(3)


@pytest.mark.parametrize("family", [["f"], []])
def test_q_of_large_families(tests, cut, family):
    rows, df = tests
    by = defaultdict(list)
    for f, k, p in rows:
        if p is not None:
            by[f if family else 0].append((p, str(f), k))
    want = {}
    for x in by.values():
        x, q = sorted(x), 1.0
        for i in range(len(x), 0, -1):
            q = min(q, x[i - 1][0] * len(x) / i)
            want[x[i - 1][1:]] = q
    out = windows.bh_fdr(df, "p", family, ["f", "k"], plain_rows=cut)
    assert out.columns == ["f", "k", "p", "q"]
    assert {(str(r.f), r.k): r.q for r in out.collect()} == pytest.approx(want | {("hot", 99): None, ("d", 1): None}, nan_ok=True)
    assert got(out) == got(windows.bh_fdr(df, "p", family, ["f", "k"]))
    audit = windows.fdr_audit(out, "p", "q", family, ["f", "k"], plain_rows=cut)
    assert got(audit) == got(windows.fdr_audit(out, "p", "q", family, ["f", "k"]))


def test_ranks_of_large_tests(tests, cut):
    df = tests[1].where("p is not null and f is not null")
    assert got(windows.avg_rank(df, ["f"], "p", plain_rows=cut)) == got(windows.avg_rank(df, ["f"], "p"))


def test_nothing(tests, cut):
    none = tests[1].limit(0)
    assert windows.bh_fdr(none, "p", [], ["k"], plain_rows=cut).count() == 0 == windows.avg_rank(none, ["f"], "p", plain_rows=cut).count()


def ranks(values):
    return [sum(y < x for y in values) + (values.count(x) + 1) / 2 for x in values]


def kruskal_p(groups):
    if len(groups) < 2:
        return None
    v = [x for g in groups for x in g]
    n, r, at, q = len(v), ranks(v), 0, 0.0
    for g in groups:
        q += sum(r[at : at + len(g)]) ** 2 / len(g)
        at += len(g)
    ties = sum(v.count(x) ** 2 - 1 for x in v)
    if ties >= n**3 - n:
        return None
    return chi2_tail((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n**3 - n)), len(groups) - 1)


@pytest.mark.parametrize("plain", [True, False])
def test_leave_one_out_kruskal(spark, plain, monkeypatch):
    if not plain:
        monkeypatch.setattr(ordered.Ordered.__init__, "__defaults__", (ordered.PLAIN_ROWS, 5))
    rnd = random.Random(6)
    rows = [(t, g, float(rnd.randrange(9))) for t in range(12) for g in "abcd"[: rnd.randint(1, 4)] for _ in range(rnd.randint(2, 6))] + [(0, None, 1.0), (0, "a", None)]
    out = loo.loo_kruskal(spark.createDataFrame(rows, "t int, g string, v double"), ["t"], "g", "v", 3, plain_rows=loo.PLAIN_ROWS if plain else 0)
    want = []
    for t in range(12):
        by = defaultdict(list)
        for u, g, v in rows:
            if u == t and g and v is not None:
                by[g].append(v)
        by = {g: x for g, x in by.items() if len(x) >= 3}
        if len(by) < 2:
            continue
        folds = []
        for g in by:
            for i in range(len(by[g])):
                left = {h: x[:i] + x[i + 1 :] if h == g else x for h, x in by.items()}
                folds.append(kruskal_p([x for x in left.values() if len(x) >= 3]))
        some, share = [p for p in folds if p is not None], sum(p is not None and p < 0.05 for p in folds) / len(folds)
        want.append((t, len(folds), kruskal_p(list(by.values())), min(some, default=None), max(some, default=None), share, share < 1))
    assert len(want) > 6 and any(len(x) for x in want)
    assert got(out, 7) == sorted((tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in want), key=repr)


def signed(d):
    big = [x for x in d if x]
    r = ranks([abs(x) for x in big])
    size = [abs(x) for x in big]
    return wilcoxon_p(len(big), sum(k for k, x in zip(r, big, strict=True) if x > 0), float(sum(size.count(x) ** 2 - 1 for x in size)), len(d) - len(big))


@pytest.mark.parametrize("plain", [True, False])
def test_leave_one_out_signed_rank(spark, plain, monkeypatch):
    if not plain:
        monkeypatch.setattr(ordered.Ordered.__init__, "__defaults__", (ordered.PLAIN_ROWS, 5))
    rnd = random.Random(7)
    rows = [(t, float(rnd.randint(-2, 6)) / (1 if t % 2 else 1 + i)) for t in range(14) for i in range(rnd.randint(1, 12))] + [(20, 0.0)] * 4 + [(21, 0.0), (21, 0.0), (21, 1.0), (21, None)]
    out = loo.loo_signed_rank(spark.createDataFrame(rows, "t int, d double"), ["t"], "d", 2, plain_rows=loo.PLAIN_ROWS if plain else 0)
    want, sign = [], lambda x: (x > 0) - (x < 0)
    for t in sorted({t for t, _ in rows}):
        d = [x for u, x in rows if u == t and x is not None]
        folds = [d[:i] + d[i + 1 :] for i in range(len(d))]
        folds = [f for f in folds if len(f) >= 2 and any(f)]
        if folds:
            p, full = [signed(f) for f in folds], signed(d)
            same = [sign(statistics.median(f)) == sign(statistics.median(d)) for f in folds]
            want.append((t, len(d), full, len(folds), sum(x < 0.05 for x in p) / len(p), sum(same) / len(same), any((x < 0.05) != (full < 0.05) for x in p)))
    assert len(want) > 8
    assert got(out, 7) == sorted((tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in want), key=repr)


def test_leave_one_out_of_large_tests(spark, monkeypatch):
    """Mann-Whitney folds and medians, cut and uncut."""
    rnd = random.Random(8)
    rows = [(t, i, rnd.choice(["HOLO", "APO", "x"]), float(rnd.randrange(12))) for t in range(4) for i in range(30)]
    df = spark.createDataFrame(rows, "t int, i int, s string, v double")
    a, b = got(loo.loo_tests(df, ["t"], "s", "v")), got(loo.loo_median(df, ["t"], ["i"], "v"))
    monkeypatch.setattr(ordered.Ordered.__init__, "__defaults__", (ordered.PLAIN_ROWS, 5))
    assert a and got(loo.loo_tests(df, ["t"], "s", "v", plain_rows=0)) == a
    assert b and got(loo.loo_median(df, ["t"], ["i"], "v", plain_rows=0)) == b
    for t, n, median, lo, hi, *_ in b:
        v = sorted(x for u, _, _, x in rows if u == t)
        folds = [statistics.median(v[:i] + v[i + 1 :]) for i in range(n)]
        assert (median, lo, hi) == (statistics.median(v), min(folds), max(folds))
    assert not any(math.isnan(x) for r in b for x in r if isinstance(x, float))
