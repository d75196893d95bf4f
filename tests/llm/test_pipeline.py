"""The pipeline's stages on small planted tables."""

import random

import numpy as np

import corpus_pipeline
from tierstats.llm import simhash

SCHEMA = "doc_id long, text string"


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def kept_rows(rows):
    """Plain version: indices of the rows that stay."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (bool(sets[i]) == bool(sets[j])) and similarity(sets[i], sets[j]) >= 0.8:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), (True, 0, i)), (d is None, d or 0, i))
    return sorted(rows[x[2]] for x in least.values())


def planted():
    rnd = random.Random(7)
    say = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    rows = []
    for n in range(60):
        base = say(100 if n % 2 else 300)
        near = list(base)
        for _ in range(1 + n % 2 if len(base) == 100 else rnd.randint(3, 7)):
            near[rnd.randrange(len(near))] = say(1)[0]
        rows += [(2 * n, " ".join(base)), (2 * n + 1, " ".join(near))]
    return rows


def test_near_copies_are_all_found(spark):
    """Pairs of similarity 0.8 to 0.95, of which fingerprints within eight bits miss many."""
    rows = planted()
    pairs = [similarity(shingles(rows[i][1]), shingles(rows[i + 1][1])) for i in range(0, len(rows), 2)]
    assert sum(0.8 <= s < 0.9 for s in pairs) >= 20
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")
    assert sorted(map(tuple, out.collect())) == kept_rows(rows)


def test_near_copies_by_small_tiles(spark, monkeypatch):
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(80):  # a chain and a crowd: neighbours are near, ends are not
        base[rnd.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(base)))
    monkeypatch.setattr(simhash, "SET_TILE", 300)
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(map(tuple, out.collect())) == kept_rows(rows)


def test_clean_short_texts_stay(spark):
    """Fingerprints of two shingles often lie near zero, that is near texts without a word, and near each other."""
    rnd = random.Random(9)
    rows = [(i, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(6))) for i in range(3000)] + [(3000 + i, t) for i, t in enumerate(("", None, " \n\t"))]
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")
    assert sorted(map(tuple, out.collect()), key=str) == sorted(rows[:3001], key=str)


def test_decisions_are_by_row(spark, tmp_path):
    """Repeated rows, texts that share an id, and null ids."""
    say = lambda a: " ".join(f"{a}{i}x" for i in range(30))
    rows = [(1, say("a")), (1, say("a")), (2, say("b")), (2, say("a")), (2, say("c")), (None, say("d")), (None, say("d")), (None, say("b")), (None, say("e"))]
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    near = sorted(map(tuple, corpus_pipeline.drop_near_copies(spark, d, "").collect()), key=str)
    assert near == sorted([(1, say("a")), (2, say("b")), (2, say("c")), (None, say("d")), (None, say("e"))], key=str)
    spark.createDataFrame([(0, say("e")), (1, say("c"))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.drop_leaks(spark, d, str(tmp_path))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([r for r in rows if r[1] not in (say("e"), say("c"))], key=str)
    assert out.columns == d.columns


def test_stages_take_hard_tables(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, clashing names, an empty table: all stages run, and what
    stays has the columns of the input."""
    names = "key row text_ kept gone h id words n_copies_ severity".split()
    schema = "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names)
    texts = [None, "", " \n", "word", "long " * 50_000, "a fine day in the old park by the river", "a fine day in the old park by the river", "vile rotten thing in the old mill by the sea"]
    rows = [(None if i == 5 else i % 6, t, None if i % 2 else "s", *[None if i % 3 else "x"] * len(names)) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, schema)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(4, 1, 1), (0, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (2, ""), (3, "w")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (d, d.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == ([*d.columns, "n_copies"] if name == "mixing" else d.columns)
            n = out.count()
            assert n <= docs.count() and (n > 0 or docs is not d)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_line_stage_is_the_plain_version(spark):
    rows = [(i, f"Header\nown line {i}\n header \n{'rare' if i < 9 else 'x'}") for i in range(12)] + [(None, "Header\nz"), (3, "header")]
    out = corpus_pipeline.drop_common_lines(spark, spark.createDataFrame(rows, SCHEMA), "")
    want = [(i, "\n".join(x for x in t.split("\n") if x.strip().lower() != "header")) for i, t in rows]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def sets_at(rnd, n, common, other):
    """n pairs of sets of 64-bit hashes with ``common`` in common and ``other`` of their own, as (sizes, hashes)."""
    sets = []
    for _ in range(n):
        base = [rnd.getrandbits(64) for _ in range(common)]
        sets += [sorted(base + [rnd.getrandbits(64) for _ in range(x)]) for x in other]
    return np.array([len(x) for x in sets]), np.array([h for x in sets for h in x], np.uint64)


def test_fingerprints_propose_the_pairs():
    """Two sets of similarity 0.8 share a band of their fingerprints and are within the radius, small ones too; unrelated sets are far apart."""
    rnd = random.Random(11)
    for common, other, n in ((4, (1, 0), 1500), (8, (1, 1), 1000), (16, (2, 2), 1000), (40, (5, 5), 600), (800, (100, 100), 60)):
        sizes, h = sets_at(rnd, n, common, other)
        bits = simhash.set_bits(sizes, h, simhash._SEEDS)
        used = (simhash.MORE if max(sizes) <= simhash.SMALL else simhash.BANDS) * simhash.BITS
        bands = simhash.band_values(bits[:, 128 : 128 + used])
        assert ((bands[::2] == bands[1::2]).any(axis=1)).mean() >= 0.998
        apart = (bits[::2] != bits[1::2])[:, :128].sum(axis=1)
        assert (apart <= simhash.WIDE).mean() >= 0.998 and 15 < apart.mean() < 26
        far = (bits[:-2:2] != bits[2::2])[:, :128].sum(axis=1)
        assert 60 < far.mean() < 68 and (far <= simhash.WIDE).mean() < 0.002


def test_proposed_groups_by_small_tiles(spark):
    """Of planted pairs each is a group of its own, by one tile or many."""
    from functools import partial

    rows = planted()
    docs = spark.createDataFrame([(i, i, t) for i, (_, t) in enumerate(rows)], "row long, id long, text string").repartition(3)
    sets = docs.mapInArrow(partial(simhash._signatures, k=5), "row long, id long, key long, fp long, fp2 long, size long, bands array<int>").cache()
    name = {r.key: r.row for r in sets.collect()}
    for tile in (1 << 14, 2):
        found = {}
        for r in simhash.proposed_groups(sets, tile).collect():
            found.setdefault(r.group, set()).add(name[r.key])
        near = {i for i in range(0, len(rows), 2) if similarity(shingles(rows[i][1]), shingles(rows[i + 1][1])) >= 0.8}
        assert near <= {min(x) for x in found.values()} and all(x == {min(x), min(x) + 1} for x in found.values())
