"""Queries that SQL cannot say, against plain versions and what must hold of their results."""

import math
import os
from collections import Counter, defaultdict

import duckdb
import pytest

from tierstats.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(spark, name):
    return catalogue.queries()[name](spark, SF).collect()


def test_every_query_has_sql_or_is_here():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"CL4_template_from_landmarks", "ML5_pca", "ML6_kmeans", "ML7_gmm", "ML7b_gmm_labels", "ML8_graph_clusters", "ML9_hierarchical", "ML10c_dbscan_clusters", "ML12_gap_statistic", "ML13c_methods_agree", "ML15_complete_entry_view", "IO6b_file_manifest"}


@pytest.mark.parametrize("name", ["ML6_kmeans", "ML7b_gmm_labels", "ML9_hierarchical"])
def test_labels_of_every_k(spark, name):
    """Every row has one label for each k from 2 on, and no more than k labels are in use."""
    by_k = defaultdict(dict)
    for r in rows(spark, name):
        assert r.id not in by_k[r.k]
        by_k[r.k][r.id] = r.cluster
    assert sorted(by_k) == list(range(2, 11)) and len({frozenset(x) for x in by_k.values()}) == 1
    assert all(len(set(x.values())) <= k for k, x in by_k.items())


def test_graph_labels(spark):
    seen = Counter((r.k, r.id) for r in rows(spark, "ML8_graph_clusters"))
    assert set(seen.values()) == {1} and {k for k, _ in seen} == set(range(2, 11))


def test_mixtures_fit_better_with_more_parts(spark):
    """Criteria from the likelihood and the number of free parameters in five dimensions."""
    got = sorted((r.k, r.log_likelihood, r.aic, r.bic, r.rounds) for r in rows(spark, "ML7_gmm"))
    n = len({r.id for r in rows(spark, "ML7b_gmm_labels")})
    assert [k for k, *_ in got] == list(range(2, 11)) and got[-1][1] > got[0][1]
    for k, ll, aic, bic, rounds in got:
        free = k - 1 + 2 * k * 5
        assert aic == pytest.approx(2 * free - 2 * ll) and bic == pytest.approx(free * math.log(n) - 2 * ll) and 0 < rounds < 100


def test_methods_agree(spark):
    """Each two of the three clusterings at each k, with indices in their ranges."""
    got = rows(spark, "ML13c_methods_agree")
    assert len(got) == 27 and {(r.method_a, r.method_b) for r in got} == {("bisecting", "kmeans"), ("bisecting", "mixture"), ("kmeans", "mixture")}
    assert all(0 <= r.rand <= 1 and -0.5 <= r.ari <= 1 for r in got) and max(r.ari for r in got) > 0.3


def test_manifest_of_the_tables(spark):
    import hashlib
    from pathlib import Path

    want = {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in Path(SF).glob("*.parquet")}
    assert {r.file: (r.bytes, r.sha256) for r in rows(spark, "IO6b_file_manifest")} == want


def test_gap_choice(spark):
    got = sorted((r.k, r.gap, r.s, r.chosen) for r in rows(spark, "ML12_gap_statistic"))
    first = next((a[0] for a, b in zip(got, got[1:], strict=False) if a[1] >= b[1] - b[2]), None)
    assert [k for k, *_, chosen in got if chosen] == ([first] if first else []) and all(s > 0 for _, _, s, _ in got)


def test_components_of_the_ratios(spark):
    ratios = [r.ratio for r in sorted(rows(spark, "ML5_pca"), key=lambda r: r.component)]
    assert ratios == sorted(ratios, reverse=True) and sum(ratios) == pytest.approx(1)


def test_complete_entries_have_two_centred_components(spark):
    by = defaultdict(list)
    for r in rows(spark, "ML15_complete_entry_view"):
        by[r.component].append(r.score)
    assert set(by) == {1, 2} and len(by[1]) == len(by[2])
    assert all(sum(x) == pytest.approx(0, abs=1e-6) for x in by.values())
    assert sum(x * x for x in by[1]) >= sum(x * x for x in by[2])


def test_landmark_templates(spark):
    """A unit has each landmark once, in the run that holds it."""
    marks = {"L1": 5, "L2": 15, "L3": 25, "L4": 35, "L5": 45}
    got = rows(spark, "CL4_template_from_landmarks")
    assert got and len({(r.unit, r.segment) for r in got}) == len(got)
    assert all(r.start <= marks[r.segment] <= r.end for r in got)
    assert max(Counter(u for u, _ in {(r.unit, r.candidate) for r in got}).values()) <= 3


def test_density_clusters_of_every_setting(spark):
    """The grid's numbers of clusters, by a plain search."""
    pts = defaultdict(list)
    for i, label, e in duckdb.execute(f"SELECT vec_id, label, embedding[1:3] FROM '{SF}/embeddings.parquet'").fetchall():
        pts[label].append((i, *(100 * float(x) for x in e)))
    apart = {(a[0], b[0]): math.dist(a[1:], b[1:]) for g in pts.values() for a in g for b in g if a[0] != b[0]}
    d = sorted(x for (a, b), x in apart.items() if a < b)

    def percentile(p):
        at = p / 100 * (len(d) - 1)
        return d[int(at)] + (d[min(int(at) + 1, len(d) - 1)] - d[int(at)]) * (at - int(at))

    want = {}
    for pct in range(10, 80, 10):
        eps, near = percentile(pct), defaultdict(set)
        for (a, b), x in apart.items():
            if x <= eps + 1e-12:
                near[a].add(b)
        for least in range(2, 6):
            core, seen, n = {a for a, x in near.items() if len(x) + 1 >= least}, set(), 0
            for a in core:
                if a not in seen:
                    n, todo = n + 1, [a]
                    while todo:
                        x = todo.pop()
                        if x not in seen:
                            seen.add(x)
                            todo += near[x] & core
            want[pct, least] = n
    assert {(r.eps_percent, r.min_samples): r.n_clusters for r in rows(spark, "ML10c_dbscan_clusters")} == want
