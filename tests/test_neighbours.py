"""Density clusters by tiles and by hashing, interval sweeps and probe contacts in pieces, identity measures, manifests."""

import math
import os
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from tierstats.operators import density, joins, matrix, ordered, pairranks, windows
from tierstats.sources import tables


def plain_dbscan(points, eps, least):
    """ids -> core flag, held flag, and the number of clusters; points as {id: (group, coordinates)}."""
    near = {a: {b for b, (h, y) in points.items() if h == g and math.dist(x, y) <= eps + 1e-12} for a, (g, x) in points.items()}
    core = {a for a, n in near.items() if len(n) >= least}
    seen, clusters = set(), 0
    for a in core:
        if a not in seen:
            clusters, todo = clusters + 1, [a]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += near[x] & core
    return core, {a for a, n in near.items() if n & core}, clusters


@pytest.mark.parametrize(("block", "few"), [(1024, 100_000), (7, 10)])
def test_grid_of_settings(spark, block, few):
    """One block a group and many, distances sorted at once and refined: the same numbers, and those of a plain search."""
    rnd = random.Random(3)
    points = {i: ("hot" if i < 60 else f"g{i % 3}", tuple(rnd.choice([rnd.gauss(0, 1), rnd.gauss(5, 0.3), 2.0]) for _ in range(3))) for i in range(90)}
    df = spark.createDataFrame([(g, i, *x) for i, (g, x) in points.items()], "g string, i long, x double, y double, z double").repartition(3)
    d = sorted(math.dist(x, y) for (g, x), (h, y) in combinations(points.values(), 2) if g == h)
    got = {(r.eps_percent, r.min_samples): r for r in density.dbscan_grid(df, "g", "i", (10, 40, 70), (2, 4), block, few).collect()}
    for pct in (10, 40, 70):
        eps = float(np.quantile(d, pct / 100))
        for least in (2, 4):
            r = got[pct, least]
            core, held, clusters = plain_dbscan(points, eps, least)
            assert r.eps == pytest.approx(eps) and (r.n_core, r.n_clusters) == (len(core), clusters) and r.noise_share == pytest.approx(1 - len(held) / 90)
    assert density.dbscan_grid(df.limit(0), "g", "i").count() == 0


def test_hashed_neighbours_have_no_wrong_pair_and_miss_few(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 48))
    x = np.concatenate([c + rng.normal(scale=0.08, size=(8, 48)) for c in centres] + [np.repeat(centres[:1], 5, axis=0), rng.normal(size=(60, 48))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [1.0, None]), (902, [1.0])], "id long, v array<double>")
    want = {(i, j) for i in range(len(x)) for j in range(len(x)) if i != j and np.linalg.norm(x[i] - x[j]) <= 0.9}
    got = {(r.probe, r.point): r.distance for r in density.vector_neighbours(df, "id", "v", 0.9).collect()}
    assert set(got) <= want and len(got) >= 0.99 * len(want) > 500
    assert all(d == pytest.approx(np.linalg.norm(x[i] - x[j])) for (i, j), d in got.items())
    core, held, clusters = plain_dbscan({i: (0, tuple(r)) for i, r in enumerate(x)}, 0.9, 4)
    found = {r.point: r for r in density.dbscan_vectors(df, "id", "v", 0.9, 4).collect()}
    assert {i for i, r in found.items() if r.is_core} == core and {i for i, r in found.items() if r.cluster is not None} == held
    assert len({r.cluster for r in found.values()} - {None}) == clusters


@pytest.mark.parametrize("cut", [False, True])
def test_intervals_of_one_hot_key(spark, monkeypatch, cut):
    if cut:
        monkeypatch.setattr(ordered.Ordered.__init__, "__defaults__", (ordered.PLAIN_ROWS, 5))
    rnd = random.Random(9)
    rows = [(1, b, b + rnd.randrange(4)) for b in (rnd.randrange(400) for _ in range(90))] + [(1, 0, 60), (2, 5, 5), (2, 6, 9), (2, 11, 12), (None, 1, 2), (None, 3, 4)]
    want = set()
    for k in {r[0] for r in rows}:
        held = None
        for _, b, e in sorted(r for r in rows if r[0] == k):
            if held and b <= held[1] + 1:
                held[1] = max(held[1], e)
            else:
                want.add((k, *held)) if held else None
                held = [b, e]
        want.add((k, *held))
    df = spark.createDataFrame(rows, "k int, b int, e int").repartition(4)
    assert {tuple(r) for r in windows.merge_intervals(df, ["k"], "b", "e", 0 if cut else 10**6).select("k", "start", "end").collect()} == want


def test_probes_far_from_every_point(spark):
    """Radii double until each probe has its nearest point; probes and points without occupancy, entries without points."""
    points = [("e", 1, 0.0, 0.0, 0.0, 1.0), ("e", 2, 3.0, 0.0, 0.0, 0.5), ("e", 3, 0.0, 1.0, 0.0, 0.0), ("none", 1, 0.0, 0.0, 0.0, None)]
    probes = [("e", 1, 4.0, 0.0, 0.0, 1.0), ("e", 1, 0.0, 1.0, 0.0, 0.0), ("e", 2, 500.0, 0.0, 0.0, 1.0), ("e", 3, 1.0, 0.0, 0.0, 0.0), ("e", 4, 7.8, 0.0, 0.0, 2.0), ("none", 5, 1.0, 0.0, 0.0, 1.0)]
    p = spark.createDataFrame(points, "entry string, pos int, x double, y double, z double, occ double")
    q = spark.createDataFrame(probes, "entry string, probe int, x double, y double, z double, occ double")
    run = lambda inventory: {r.probe: tuple(r)[2:] for r in joins.probe_contacts(p, q, "entry", "pos", "probe", "occ", inventory=inventory).collect()}
    want = {1: (1, 1.0, True, True, [1, 2]), 2: (1, 497.0, False, False, []), 3: (1, 1.0, True, True, [1, 2]), 4: (1, 4.8, False, True, []), 5: (1, None, False, False, [])}
    got = run(True)
    assert {k: (*v[:1], v[1] and round(v[1], 9), *v[2:]) for k, v in got.items()} == want
    assert set(run(False)) == {1, 2, 4, 5}


def test_one_partner_rule(spark):
    a = spark.createDataFrame([(k, 1, 100) for k in range(4)], "k int, b int, e int")
    b = spark.createDataFrame([(0, 1, 90, "p"), (1, 1, 90, "p"), (1, 5, 9, "q"), (2, 200, 300, "p")], "k int, b int, e int, who string")
    got = {r.k: (r.n_partners, r.overlap, r.relation) for r in joins.overlap_fraction(a, b, partner="who").collect()}
    assert got == {0: (1, 90, "SAME"), 1: (2, None, "AMBIGUOUS"), 2: (1, 0, "DISJOINT"), 3: (0, None, "AMBIGUOUS")}


def test_disjoint_pairs_without_pairs(spark, monkeypatch):
    rnd = random.Random(2)
    r = [(i, *sorted((rnd.randrange(60), rnd.randrange(60)))) for i in range(40)]
    want = sum(a[2] < b[1] or b[2] < a[1] for a, b in combinations(r, 2))
    df = spark.createDataFrame(r, "u int, lo int, hi int")
    assert tuple(joins.disjoint_pairs(df, "u", "lo", "hi").first()) == (40, 780, want)
    monkeypatch.setattr(ordered.Ordered.__init__, "__defaults__", (0, 7))
    assert tuple(joins.disjoint_pairs(df, "u", "lo", "hi").first()) == (40, 780, want)


def test_rand_table_of_equal_and_unrelated_labels(spark):
    rows = [(i, m, k, c) for i in range(60) for k in (2, 3) for m, c in (("a", i % k), ("b", (i + 1) % k), ("c", i * i // 7 % k))]
    got = {(r.k, r.method_a, r.method_b): r for r in matrix.rand_table(spark.createDataFrame(rows, "id int, method string, k int, cluster int")).collect()}
    assert len(got) == 6 and all(got[k, "a", "b"].ari == pytest.approx(1) and got[k, "a", "b"].rand == 1 for k in (2, 3))
    assert all(abs(got[k, "a", "c"].ari) < 0.2 and got[k, "a", "c"].n == 60 for k in (2, 3))


def test_projections_keep_or_lose_distances(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(scale=0.1, size=(25, 40)), rng.normal(loc=3, scale=0.1, size=(25, 40))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, x array<double>")
    signs = np.array(matrix.projection_signs(40, 10, 1))
    assert abs(signs.mean()) < 0.25 and (np.array(matrix.projection_signs(40, 10, 2)) != signs).any()
    got = matrix.projection_stability(df, 40, 10, (1, 2)).collect()
    assert {(r.seed, r.n_pairs, r.status) for r in got} == {(1, 1225, "STABLE"), (2, 1225, "STABLE")}
    assert got[0].mean_spearman == pytest.approx(sum(r.spearman for r in got) / 2)


def test_a_changed_byte_is_reported(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    for d in (a, b):
        os.makedirs(d)
        (d / "same.bin").write_bytes(b"x" * 1000)
        (d / "other.bin").write_bytes(b"y" * 1000 + (b"0" if d == a else b"1"))
        (d / f"only_{d.name}.bin").write_bytes(b"z")
    got = tables.compare_manifests(tables.file_manifest(spark, str(a), "*.bin"), tables.file_manifest(spark, str(b), "*.bin"))
    assert {r.file: r.status for r in got.collect()} == {"same.bin": "SAME", "other.bin": "CHANGED", "only_a.bin": "REMOVED", "only_b.bin": "ADDED"}


def test_positions_of_sites_without_other_controls(spark, monkeypatch):
    from tierstats.operators import layers

    by = defaultdict(set)
    sites = spark.createDataFrame([(1, "s", 1)], "unit int, site string, position int")
    segmap = spark.createDataFrame([(p, f"seg{p}", f"c{p}") for p in range(1, 40)], "position int, segment string, cls string")
    for slice_positions in (100_000, 10):
        monkeypatch.setattr(layers, "SLICE_POSITIONS", slice_positions)
        for r in layers.matched_controls(sites, segmap).collect():
            by[slice_positions].add((r.position, r.tier))
    assert by[10] == by[100_000] == {(p, "named_only") for p in range(2, 40)}


def test_vectors_that_are_nearly_all_alike_in_their_buckets(spark):
    """Vectors whose buckets hold nearly all of them made a row of every pair, in every hash table. Here in several blocks, with copies,
    a null and vectors of another length, against plain pairs."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8)).astype(np.float32).astype(float)
    x[50:60] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0]), (902, [None] * 8)], "id long, v array<double>")
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= 1.6
    core = near.sum(1) >= 6
    root = np.where(core, np.arange(400), 999)
    while not (root == (new := np.where(core, np.where(near & core[None], root[None], 999).min(1), 999))).all():
        root = new
    want = {i: (bool(core[i]), int(root[i]) if core[i] else int(root[np.flatnonzero(near[i] & core)[0]]) if (near[i] & core).any() else None) for i in range(400)} | {901: (False, None), 902: (False, None)}
    assert core.any() and not core.all()
    for block in (60, 130, 4096):  # even and odd numbers of blocks
        got = {r.point: (r.is_core, r.cluster) for r in density.dbscan_vectors(df, "id", "v", 1.6, 6, block_points=block).collect()}
        assert got == want


def test_points_by_tiles_are_dbscan_by_brute_force(spark):
    """Small blocks, a point without a group and one without a coordinate; the id of a cluster is its smallest core."""
    import random

    from tierstats.operators import density

    rnd = random.Random(3)
    rows = [(i, i % 2, *(rnd.uniform(0, 40) for _ in range(3))) for i in range(140)] + [(200, None, 1.0, 1.0, 1.0), (201, 0, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, g int, x double, y double, z double")
    got = {r["point"]: (r["is_core"], r["cluster"]) for r in density.dbscan_points(df, "g", "id", 7.0, 4, block_points=16).collect()}
    good = [r for r in rows if None not in r]
    near = {a[0]: [b[0] for b in good if a[1] == b[1] and sum((p - q) ** 2 for p, q in zip(a[2:], b[2:], strict=True)) ** 0.5 <= 7.0] for a in good}
    core = {i for i, n in near.items() if len(n) >= 4}
    root = {i: i for i in core}
    for _ in core:
        root = {i: min(root[j] for j in near[i] if j in core) for i in core}
    want = {i: (i in core, root[i] if i in core else root[min(set(near[i]) & core)] if set(near[i]) & core else None) for i in near}
    assert got == want | {200: (False, None), 201: (False, None)}
    assert 0 < len(core) < len(good)


def plain_rank_correlation(x, turn):
    """n of pairs and Spearman's coefficient, from all pairs; what is no number is last."""
    def ranks(v):
        d = [round(math.dist(v[i], v[j]), 9) for i in range(len(v)) for j in range(i)]
        d = [math.inf if math.isnan(y) else y for y in d]
        at, n = {}, 0
        for y, m in sorted(Counter(d).items()):
            at[y], n = n + (m + 1) / 2, n + m
        return [at[y] for y in d]

    a, b = ranks(x), ranks(x @ turn)
    return len(a), float(np.corrcoef(a, b)[0, 1])


@pytest.mark.parametrize("odd", [False, True])
def test_rank_correlation_makes_no_row_a_pair(spark, monkeypatch, odd):
    """By small blocks and bins; no table that is written, and no group, has a row for each pair. Odd: copies, ties, and what is no vector."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, size=(150, 4)).astype(float) if odd else rng.normal(size=(150, 4))
    if odd:
        x[40:70], x[70] = x[0], np.nan
    turns = [rng.integers(-1, 2, size=(4, 2)).astype(float) for _ in range(2)]
    written, write = [], pairranks.staged
    monkeypatch.setattr(pairranks, "staged", lambda df, name: written.append(write(df, name)) or written[-1])
    rows = [(i, None if np.isnan(r[0]) else [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, x array<double>")
    got = {r.view: (r.n_pairs, r.spearman) for r in pairranks.distance_rank_correlations(df, 4, turns, bin_pairs=200, block_points=64).collect()}
    for i, t in enumerate(turns):
        n, rho = plain_rank_correlation(x, t)
        assert got[i] == (n, pytest.approx(rho, abs=1e-9))
    assert written and pairranks.distance_rank_correlations(df.limit(1), 4, turns).count() == 0 == pairranks.distance_rank_correlations(df.limit(0), 4, turns).count()


def test_stability_writes_less_than_pairs(spark, monkeypatch):
    from tierstats.operators import matrix as M

    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(120, 6)))], "id int, x array<double>")
    sizes = []
    for module in (M, pairranks):
        write = module.staged
        monkeypatch.setattr(module, "staged", lambda t, name, write=write: sizes.append((out := write(t, name)).count()) or out)
    assert M.projection_stability(df, 6, 3, (1, 2)).count() == 2
    assert max(sizes) <= 120


def test_rank_correlation_leaves_nothing_of_its_pairs_on_disk(spark, monkeypatch):
    """What was shuffled stayed until the end, some 52 bytes a pair. Now ranges of distances have their turns, and a turn's files go with it."""
    import glob

    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 4))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, x array<double>")
    turns = [rng.integers(-1, 2, size=(4, 2)).astype(float)]
    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    held = lambda: sum(os.path.getsize(f) for d in dirs for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True))
    before = held()
    whole = pairranks.distance_rank_correlations(df, 4, turns, bin_pairs=20_000).collect()
    assert held() - before < 4 * 700 * 699 // 2
    n, rho = plain_rank_correlation(x, turns[0])
    assert [(r.view, r.n_pairs) for r in whole] == [(0, n)] and whole[0].spearman == pytest.approx(rho, abs=1e-9)
    monkeypatch.setattr(pairranks, "STRIP", 700)  # strips of which a turn takes no pair
    parts = pairranks.distance_rank_correlations(df, 4, turns, bin_pairs=20_000, round_bytes=600_000).collect()  # several turns
    assert parts[0].spearman == pytest.approx(rho, abs=1e-9)


def test_rank_correlation_of_distances_that_are_near_each_other(spark):
    """A far vector, next to which all other distances are alike: the cells of distances are cut until they tell ranks apart. With copies."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(60, 4)), np.full((1, 4), 1e6)])
    x[20:25] = x[0]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, x array<double>")
    turn = rng.integers(-1, 2, size=(4, 2)).astype(float)
    n, rho = plain_rank_correlation(x, turn)
    got = pairranks.distance_rank_correlations(df, 4, [turn], bin_pairs=100, round_bytes=5_000).collect()
    assert got[0].n_pairs == n and got[0].spearman == pytest.approx(rho, abs=1e-6)  # nine digits of distances of 1e6


def test_manifest_reads_files_in_pieces(spark, tmp_path):
    """A file was one row, of its whole content. Odd ends, marks of byte order, names to encode, several splits, and files that Spark would unpack."""
    import gzip
    import hashlib

    rng = np.random.default_rng(2)
    mark = b"\xef\xbb\xbf"
    files = {f"r{i}.bin": b for i, b in enumerate([b"a", b"\n", b"\n\n", b"a\n", b"\r\n\r", b"\xff\n\xfe\x00", mark, mark + b"\n", mark + b"x", mark + mark + b"\nx", b"\xef\xbb", rng.bytes(3_000_001), bytes(100_000)])}
    files |= {"a b%20c.bin": rng.bytes(5000), "p.gz": gzip.compress(rng.bytes(3000)), "no.gz": b"\n plain", "q.bin.zst": rng.bytes(70)}
    (tmp_path / "in").mkdir()
    for k, (name, content) in enumerate(files.items()):
        ((tmp_path / "in" if k % 2 else tmp_path) / name).write_bytes(content)
    want = {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in files.items()}
    conf = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.sources.binaryFile.maxLength")}
    try:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", "4000")  # what a row may hold of a file
        for size in (conf["spark.sql.files.maxPartitionBytes"], "70000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = tables.file_manifest(spark, str(tmp_path)).collect()
            assert {r.file: (r.bytes, r.sha256) for r in got} == want and len(got) == len(files)
    finally:
        for k, v in conf.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("block", [5, 40, 2048])
def test_grid_of_chains_and_far_points(spark, block):
    """Chains between blobs, far points and pairs, a group with few points, points without a group or coordinate, which met each other or had no
    distance before; what joins no cluster of a group's first block is compared with all."""
    rnd = random.Random(11)
    blob = lambda x, n, r: [(x + rnd.gauss(0, r), rnd.gauss(0, r), rnd.gauss(0, r)) for _ in range(n)]
    a = blob(0, 30, 0.3) + blob(6, 25, 0.3) + [(i * 0.8, 0.0, 9.0) for i in range(20)] + [(50.0 + 9 * i, 3.0 * i, 0.0) for i in range(6)] + [(30.0, 0.0, 0.0), (30.0, 0.1, 0.0)]
    points = dict(enumerate([("a", p) for p in a] + [("b", p) for p in blob(2, 3, 4.0)]))
    rows = [(g, i, *p) for i, (g, p) in points.items()] + [(None, 900 + i, 0.0, 0.0, 0.1 * i) for i in range(4)] + [("a", 950, None, 0.0, 0.0), ("a", 951, 0.0, None, 0.0)]
    df = spark.createDataFrame(rows, "g string, i long, x double, y double, z double")
    d = sorted(math.dist(x, y) for (g, x), (h, y) in combinations(points.values(), 2) if g == h)
    got = {(r.eps_percent, r.min_samples): r for r in density.dbscan_grid(df, "g", "i", (1, 3, 8, 30, 60), (2, 3, 5), block).collect()}
    clusters_seen = set()
    for pct in (1, 3, 8, 30, 60):
        eps = float(np.quantile(d, pct / 100))
        for least in (2, 3, 5):
            r = got[pct, least]
            core, held, clusters = plain_dbscan(points, eps, least)
            clusters_seen.add(clusters)
            assert (r.n_core, r.n_clusters) == (len(core), clusters) and r.noise_share == pytest.approx(1 - len(held) / len(rows))
    assert len(clusters_seen) > 3
