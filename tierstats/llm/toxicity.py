"""Toxicity severity by cumulative-link ordinal regression on sparse word features."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Bound on the labelled rows that the model is fitted on; those of smallest hash are taken.
MAX_LABELLED = 20_000
#: Bound on the features.
MAX_FEATURES = 4_000
#: Longer words count by their first letters too, so that inflected and compound forms of a mark are marks.
STEMS = (4, 5, 6)
#: A word or stem is a feature if at least so many labelled documents have it and its association with the label is so strong (G-squared).
MIN_DOCS, MIN_G2 = 3, 15.0
#: A feature marks toxic texts if it is so many times as common among them.
MARK_RATIO = 5.0
GRADES = 3

WORD = re.compile(r"[^\W\d_]+")


#: Penalties: the pooled features are nearly free, single words only add to them.
RIDGE_POOLED, RIDGE_WORD = 0.1, 3.0


class Model(NamedTuple):
    """P(grade > k) = logistic(score - thresholds[k]): one set of weights, shared by all thresholds.

    The score sums weight x value over the words and stems of a text, and ``pooled`` x two values of all features
    together that mark toxic texts (``marks``): their number and their share of the words. So a rare mark counts as one
    too, and a chance mark in a long text for little.
    """

    weights: dict[str, float]
    thresholds: tuple[float, ...]
    pooled: tuple[float, float] = (0.0, 0.0)
    marks: frozenset[str] = frozenset()

    def score(self, counts: dict[str, int], n: int) -> float:
        marked = sum(c for f, c in counts.items() if f in self.marks)
        pooled = sum(w * v for w, v in zip(self.pooled, pooled_values(marked, n), strict=True)) if marked else 0.0
        return sum(self.weights[f] * value(c) for f, c in counts.items()) + pooled


def forms(word: str) -> tuple[str, ...]:
    """The features a word counts for."""
    return (word, *(word[:k] + "*" for k in STEMS if len(word) > k))


def counts_of(text: str) -> tuple[dict[str, int], int]:
    """How often each word and each stem stands in the text, and its number of words."""
    words, found = Counter(WORD.findall(text.lower())), {}
    for w, c in words.items():
        for f in forms(w):
            found[f] = found.get(f, 0) + c
    return found, sum(words.values())


def value(count: float | np.ndarray) -> float | np.ndarray:
    """Feature value of a word that stands ``count`` times."""
    return 1 + np.log(count)


def pooled_values(marked: int, n: int) -> tuple[float, float]:
    """Values of ``marked`` marks among n words: by number and by share."""
    return 1 + float(np.log(marked)), float(np.log1p(1000 * marked / max(1, n)))


def fit_ordinal(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, ridge: np.ndarray, grades: int = GRADES, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of the proportional-odds model by gradient steps (Adam).

    x: (feature numbers, values) for each row; ridge: penalty of each feature's weight. Thresholds are a first one plus positive gaps, so they stay ordered.
    """
    row = np.repeat(np.arange(len(x)), [len(i) for i, _ in x])
    col = np.concatenate([i for i, _ in x]) if len(row) else np.zeros(0, np.int64)
    val = np.concatenate([v for _, v in x]) if len(row) else np.zeros(0)
    n, n_features = len(x), len(ridge)
    share = np.clip([(y > k).mean() for k in range(grades - 1)], 1e-4, 1 - 1e-4)
    start = -np.log(share / (1 - share))
    p = np.concatenate([np.zeros(n_features), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        w, gaps = p[:n_features], np.exp(p[n_features + 1 :])
        theta = p[n_features] + np.concatenate([[0], np.cumsum(gaps)])
        s = np.bincount(row, val * w[col], n)
        above = np.concatenate([np.ones((n, 1)), sig(s[:, None] - theta[None, :]), np.zeros((n, 1))], axis=1)
        hi, lo = above[np.arange(n), y], above[np.arange(n), y + 1]
        like = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / like, lo * (1 - lo) / like
        d_s = -(d_hi - d_lo)  # of the negative log likelihood
        d_theta = np.array([(d_hi * (y == k + 1)).sum() - (d_lo * (y == k)).sum() for k in range(grades - 1)])
        g_w = np.bincount(col, val * d_s[row], n_features) + ridge * w
        g = np.concatenate([g_w, [d_theta.sum()], [d_theta[k + 1 :].sum() * gaps[k] for k in range(grades - 2)]]) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:n_features], p[n_features] + np.concatenate([[0], np.cumsum(np.exp(p[n_features + 1 :]))])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, y, text) -> (id, y, words, counts, n)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            b = batch.slice(at, 256)
            words, counts, totals = [], [], []
            for t in b.column(2):
                found, n = counts_of(t.as_py() or "")
                words.append(list(found))
                counts.append(list(found.values()))
                totals.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64())), pa.array(totals, pa.int64())], names=["id", "y", "words", "counts", "n"])


def _kept_features(names: list[str]):
    """(y, h, n, words, counts) -> (y, h, n, at, counts): the features' numbers, in order, instead of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(names, pa.string())
        for b in batches:
            words = b.column(3)
            number = pc.index_in(words.flatten(), known)
            hit = np.asarray(number.is_valid())
            row = np.repeat(np.arange(len(words)), np.asarray(words.value_lengths()))[hit]
            at, counts = np.asarray(number.drop_null()).astype(np.int64), np.asarray(b.column(4).flatten())[hit]
            order = np.lexsort((at, row))
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(words)))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[order], pa.int64())) for x in (at, counts)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *lists], names=["y", "h", "n", "at", "counts"])

    return run


def g_squared(a: Column, b: Column, n1: float, n0: float) -> Column:
    """How strongly a word that ``a`` of n1 toxic and ``b`` of n0 other documents have tells the two apart."""
    has, total = a + b, n1 + n0
    term = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(F.lit(0.0))
    return 2 * (term(a, has * n1 / total) + term(b, has * n0 / total) + term(n1 - a, (total - has) * n1 / total) + term(n0 - b, (total - has) * n0 / total))


def cross_fitted_rates(half: np.ndarray, toxic: np.ndarray, n: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """Share of each row's words that mark toxic documents, by the marks of the other half of the rows."""
    rate = np.zeros(len(rows))
    for side in (0, 1):
        seen = np.zeros((2, size))
        total = [max(1, int((toxic[half == side] == y).sum())) for y in (0, 1)]
        for i in np.flatnonzero(half == side):
            seen[int(toxic[i]), rows[i][0]] += 1
        marks = (seen[1] >= 2) & (seen[1] / total[1] > 2 * seen[0] / total[0])
        for i in np.flatnonzero(half != side):
            at, counts = rows[i]
            rate[i] = counts[marks[at]].sum() / max(1, n[i])
    return rate


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most MAX_LABELLED labelled documents.

    Labels above 1 are severity grades as they are (up to GRADES - 1). Where all are 0 or 1, toxic documents get grade
    2 if their share of marked words is above the median of toxic documents, by marks that were learned on the other
    half of the labelled rows, so that no document is graded by its own label. An id with several labels has the
    highest, an id with several texts the one of smallest hash; null ids and null labels are left out. Without both
    labels, and for empty tables, the model finds nothing.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    known = staged(known.orderBy(F.xxhash64("id"), "id").limit(MAX_LABELLED), "toxic-labels")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("k"), F.struct(F.xxhash64(text).alias("h"), text.alias("text")).alias("t")).join(F.broadcast(known), F.col("k") == F.col("id"))
    texts = texts.groupBy("id", "y").agg(F.min("t").alias("t")).select("id", "y", "t.text")  # one row an id: at most MAX_LABELLED
    id_type = known.schema["id"].dataType.simpleString()
    rows = staged(texts.mapInArrow(_counted, f"id {id_type}, y int, words array<string>, counts array<long>, n long"), "toxic-words")
    sizes = {r["y"]: r["n"] for r in rows.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    nothing = Model({}, tuple(float(30 + k) for k in range(GRADES - 1)))
    if not n1 or not n0:
        return nothing
    by_word = rows.select((F.col("y") > 0).cast("int").alias("y"), F.explode("words").alias("word")).groupBy("word").agg(F.sum("y").cast("double").alias("a"), F.sum(1 - F.col("y")).cast("double").alias("b"))
    chosen = by_word.where(F.col("a") + F.col("b") >= MIN_DOCS).withColumn("g2", g_squared(F.col("a"), F.col("b"), n1, n0)).where(F.col("g2") >= MIN_G2).orderBy(F.desc("g2"), "word").limit(MAX_FEATURES).collect()
    if not chosen:
        return nothing
    mark = np.array([r["a"] / n1 > MARK_RATIO * r["b"] / n0 for r in chosen])
    numbers = {r["word"]: i for i, r in enumerate(chosen)}
    kept = rows.select("y", F.xxhash64("id").alias("h"), "n", "words", "counts").mapInArrow(_kept_features(list(numbers)), "y int, h long, n long, at array<long>, counts array<long>")
    sample = sorted(kept.collect(), key=lambda r: (r["h"], r["y"], r["n"], r["at"], r["counts"]))  # one row an id, of at most MAX_FEATURES entries
    found = [(np.array(r["at"], np.int64), np.array(r["counts"], np.int64)) for r in sample]
    y = np.array([r["y"] for r in sample])
    if y.max() <= 1:
        rate = cross_fitted_rates(np.array([r["h"] & 1 for r in sample]), y > 0, np.array([r["n"] for r in sample]), found, len(chosen))
        y = np.where(y > 0, 1 + (rate > np.median(rate[y > 0])), 0)
    k, x = len(chosen), []  # the pooled features are the last two
    for r, (at, counts) in zip(sample, found, strict=True):
        marked = int(counts[mark[at]].sum())
        x.append((np.append(at, [k, k + 1]), np.append(value(counts), pooled_values(marked, r["n"]))) if marked else (at, value(counts)))
    w, theta = fit_ordinal(x, np.clip(y, 0, GRADES - 1), np.array([RIDGE_WORD] * k + [RIDGE_POOLED] * 2))
    return Model({f: float(w[i]) for f, i in numbers.items()}, tuple(theta.tolist()), (float(w[k]), float(w[k + 1])), frozenset(f for f, i in numbers.items() if mark[i]))


def severity(model: Model, texts: Iterable[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade and P(grade > 0) for each of n texts, which are read one at a time."""
    s, names = np.zeros(n), model.weights
    known: dict[str, tuple[str, ...]] = {}  # word -> its features
    for i, text in enumerate(texts):
        counts: dict[str, int] = {}
        words = Counter(WORD.findall(text.lower()))
        for w, c in words.items():
            if (own := known.get(w)) is None:
                own = known[w] = tuple(f for f in forms(w) if f in names)
            for f in own:
                counts[f] = counts.get(f, 0) + c
        s[i] = model.score(counts, sum(words.values()))
        if len(known) > 1 << 16:
            known.clear()
    above = 1 / (1 + np.exp(-np.clip(s[:, None] - np.array(model.thresholds)[None, :], -30, 30)))
    return above.sum(axis=1), above[:, 0]


def scored_rows(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row, severity, p_toxic): all columns of ``docs`` as a struct, so that no name clashes."""

    @F.arrow_udf("struct<severity:double,p_toxic:double>")
    def score(texts: pa.Array) -> pa.Array:
        found = severity(model, (t.as_py() or "" for t in texts), len(texts))
        return pa.StructArray.from_arrays([pa.array(x) for x in found], names=["severity", "p_toxic"])

    scored = docs.select(F.struct("*").alias("row"), score(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("s"))
    return scored.select("row", "s.severity", "s.p_toxic")


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with ``severity`` (0 to GRADES - 1, expected) and ``p_toxic``; columns that
    have these names already give way to them.

    Null text is empty and has the severity of a text without marked words; long texts are read whole. Repeated rows
    have a score each. Empty table: empty result.
    """
    own = ("severity", "p_toxic")
    return scored_rows(docs, model, text_col).select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in own), *own)


def op9(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", F.round("severity", 6).alias("severity"), F.round("p_toxic", 6).alias("p_toxic"), (F.col("p_toxic") >= 0.5).alias("toxic"))
