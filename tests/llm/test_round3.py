"""Hard negatives, sharding and periodic runs against plain versions: nulls, empty and very long texts, ties, repeated rows,
empty tables, extra columns with clashing names."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierstats.llm import negatives, periods, shards

from .brute import WORD

CLASH = "id string, source string, h string, text string, doc_id long, nth string, runs string, place string, extra string, rank string, last string, score string, anchor string"


def plain_runs(w, min_words=6, min_exponent=4):
    found = {}
    for q in range(1, len(w)):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(min_words, min_exponent * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize(("min_words", "min_exponent"), [(6, 4), (1, 2), (2, 3)])
def test_runs_of_random_words(min_words, min_exponent):
    rnd = random.Random(min_exponent)
    for _ in range(400):
        texts = []
        for _ in range(rnd.randint(1, 4)):
            n, k = rnd.randint(0, 60), rnd.randint(1, 4)
            w = [rnd.randrange(k) for _ in range(n)]
            if n and rnd.random() < 0.5:
                a = rnd.randrange(n)
                p = rnd.randint(1, min(8, n - a))
                w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
            texts.append(w)
        first = np.cumsum([0] + [len(t) for t in texts])
        symbols = np.unique([d * 10 + x for d, t in enumerate(texts) for x in t], return_inverse=True)[1].astype(np.int64)
        want = sorted(((s + int(first[d]), n, q) for d, t in enumerate(texts) for s, n, q in plain_runs(t, min_words, min_exponent)), key=lambda r: (r[0], r[2]))
        assert periods.word_runs(symbols, first, min_words, min_exponent) == want


def texts():
    rnd = random.Random(3)
    say = lambda n: " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(n))
    long = " ".join(str(rnd.randrange(50_000)) for _ in range(60_000))
    return [
        (1, None), (2, ""), (3, " \n\t\x0b "), (4, "one"), (5, "a a a a a"), (6, "a a a a a a"), (7, "x " + "ä ö " * 4 + "ä z"), (8, "no\n" * 3000), (9, say(40)), (None, "b c " * 6), (10, "twice " * 7), (10, "twice " * 7),
        (11, long + " " + "p q r " * 2000 + long), (12, "w" * 100_000),
    ]


def with_clashes(spark, rows, parts=3):
    return spark.createDataFrame([("x", None if n % 5 == 0 else f"s{n % 3}", "x", t, i, "x", "x", "x", "x", "x", "x", "x", "x") for n, (i, t) in enumerate(rows)], CLASH).repartition(parts)


def test_periodic_runs(spark):
    rows = texts()
    docs = with_clashes(spark, rows)
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periods.periodic_runs(docs).collect()), key=repr)
    want = []
    for i, t in rows:
        w = WORD.findall(t or "")
        runs = plain_runs(w) if len(w) < 10_000 else [(60_000, 6_000, 3)]
        want.append((i, runs, collapsed(w, runs)))
    assert got == sorted(want, key=repr)
    assert periods.periodic_runs(docs.limit(0)).count() == 0


def test_planted_tails(spark):
    """The query's words are those of its contract, ids of any kind."""
    rows = [(i, " ".join(f"{i}-{k}" for k in range(i % 90))) for i in range(300)] + [(None, "a b c"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", periods._planted(F.col("doc_id"), F.col("text")).alias("planted"))
    hit = 0
    for r in df.collect():
        w = WORD.findall(r.text or "")
        h = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
            hit += 1
        assert WORD.findall(r.planted or "") == w
    assert hit > 10


def shard_rows(rows, n_shards, seed=0):
    """(source, shard, slot) for each row, by sorting; rows as (id, source, text)."""
    h = lambda i, t: int(hashlib.md5(f"{seed} {'' if i is None else i} {t or ''}".encode()).hexdigest()[:15], 16)
    by = defaultdict(list)
    for i, s, t in rows:
        by[s].append((h(i, t), i, t))
    order = sorted(((2 * k + 1) / (2 * len(x)), s is None, s or "", k, i, t) for s, x in by.items() for k, (_, i, t) in enumerate(sorted(x, key=lambda e: e[0])))
    n, out = len(order), []
    for place, (_, last, s, _, i, t) in enumerate(order):
        shard = place * n_shards // n
        out.append((i, None if last else s, shard, place - -(-shard * n // n_shards)))
    return out


@pytest.mark.parametrize("part_rows", [1 << 18, 7])
def test_interleaving(spark, monkeypatch, part_rows):
    monkeypatch.setattr(shards, "PART_ROWS", part_rows)
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["hot"] * 6 + ["b", "c", None, ""]), rnd.choice([None, "", "t" * rnd.randrange(40)])) for i in range(200)]
    rows += [(None, "hot", "same")] * 50 + [(5, "b", "twice")] * 2
    df = spark.createDataFrame([(i, s, t, "x", "x", 1.0) for i, s, t in rows], "doc_id long, source string, text string, place string, h string, last double").repartition(5)
    got = shards.interleave(df, 24, extra={"size": F.length("text")}).collect()
    assert sorted(((r.doc_id, r.source, r.shard, r.slot) for r in got), key=repr) == sorted(shard_rows(rows, 24), key=repr)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert sorted(r.place for r in got) == list(range(len(rows)))
    share = len([1 for _, s, _ in rows if s == "hot"]) / len(rows)
    by = Counter(r.shard for r in got if r.source == "hot")
    assert all(abs(by[k] - share * sizes[k]) <= 1.5 for k in sizes)  # every shard has the mixture
    assert shards.interleave(df.limit(0), 24).count() == 0
    assert {r.shard for r in shards.interleave(df.limit(1), 24).collect()} == {0}


def plain_negatives(rows, is_anchor, positives=5, negatives_=3, low=50, high=95, scale=256):
    """rows of (id, label, vector)."""
    ok = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [math.floor(scale * x) for x in v])
        ok[i] = min(ok.get(i, row), row)
    out = []
    for a, (label, v) in ok.items():
        if not is_anchor(a):
            continue
        ranked = sorted((-sum(p * q for p, q in zip(v, w, strict=False)), i, l) for i, (l, w) in ok.items() if i != a)
        for s, i, _ in [r for r in ranked if r[2] == label][:positives]:
            fits = [(n, k) for n, k, l in ranked if l != label and low * -s <= 100 * -n <= high * -s]
            out += [(a, i, r + 1, k, -s, -n) for r, (n, k) in enumerate(fits[:negatives_])]
    return sorted(out)


@pytest.mark.parametrize("block", [8192, 16])
def test_hard_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", 8)
    rnd = random.Random(2)
    rows = [(i, rnd.choice([1, 1, 1, 2, 3]), [rnd.choice([0.0, rnd.uniform(-1, 1), 0.5]) for _ in range(6)]) for i in range(-30, 220)]
    same = [0.25, 0.5, 0.0, 0.0, 0.0, 1.0]
    rows += [(i, i % 2, same) for i in range(300, 360)]  # ties
    rows += [(400, None, same), (410, 1, None), (420, 1, [0.5, None]), (430, 1, [0.5, math.nan]), (440, 1, [math.inf]), (None, 1, same)]
    rows += [(450, 1, []), (460, 2, [1.0, 1.0]), (470, 2, [0.5] * 9), (10, 1, same), (10, 1, same), (480, 1, [0.0] * 6), (490, 2, [0.0] * 6), (500, 2, [1e5] * 6)]
    df = spark.createDataFrame([(i, l, v, "x", 0, 0) for i, l, v in rows], "vec_id long, label int, embedding array<double>, id string, x int, score int").repartition(4)
    got = sorted(tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect())
    assert got and got == plain_negatives(rows, lambda i: i % 10 == 0)
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.hard_negatives(df, F.col("vec_id") == -999).count() == 0


def test_large_components_are_exact():
    """Beyond what doubles hold, products are whole numbers still."""
    a = np.array([[float(1 << 40), 3.0]])
    b = np.array([[float(1 << 20), 1.0], [float(1 << 40), 0.0]])
    assert negatives.scores(a, b).tolist() == [[(1 << 60) + 3, 1 << 62]]


def test_windows_open_along_the_order():
    """Ties, a positive of score 0 and keys of one anchor after another, without the tiles."""
    pairs = [(1, 100, False, 7), (1, 95, True, 3), (1, 96, True, 4), (1, 50, True, 9), (1, 49, True, 2), (1, 80, False, 5), (1, 76, True, 6), (2, 0, False, 8), (2, 0, True, 1), (2, -1, True, 3), (-3, -5, False, 1), (-3, -5, True, 2)]
    keys = sorted(negatives.pack_key(*p) for p in pairs)
    assert list(negatives.mined(iter(keys), 5, 3, 50, 95)) == [
        (1, 7, 1, 3, 100, 95), (1, 7, 2, 6, 100, 76), (1, 5, 1, 6, 80, 76), (1, 7, 3, 9, 100, 50), (1, 5, 2, 9, 80, 50), (1, 5, 3, 2, 80, 49), (2, 8, 1, 1, 0, 0),
    ]
