"""Periodic runs of words, by an enhanced suffix array of each text.

Texts are independent, so Spark maps over batches of rows and nothing is shuffled; within a batch a bounded number of words
is worked at once, a long text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, word_count
from .words import Chunk, chunks, mix, word_hashes

#: A run has at least so many words, and at least so many periods.
MIN_WORDS, MIN_EXPONENT = 6, 4
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class SuffixArray:
    """Suffix array, its inverse and common prefixes of many texts at once: words of different texts are different symbols,
    so no two suffixes of different texts share a prefix.

    ``levels[k]`` ranks the positions by their first 2^k words (the rank of a group is that of its first member), up to the
    level on which all differ. Each round sorts only positions whose group has more than one member.
    """

    def __init__(self, symbols: np.ndarray, stops: np.ndarray):
        n = len(symbols)
        self.symbols, self.stops = symbols, stops
        count = np.bincount(symbols)
        rank = (np.cumsum(count) - count)[symbols]
        self.levels = [rank]
        open_, step = np.flatnonzero(count[symbols] > 1), 1
        while len(open_):
            far = open_ + step
            then = np.where(far < stops[open_], rank[np.minimum(far, n - 1)], -1)
            order = np.lexsort((then, rank[open_]))
            at, own, then = open_[order], rank[open_][order], then[order]
            group = np.concatenate([[True], own[1:] != own[:-1]])
            part = group | np.concatenate([[True], then[1:] != then[:-1]])
            i = np.arange(len(at))
            rank = rank.copy()
            rank[at] = own + np.maximum.accumulate(np.where(part, i, 0)) - np.maximum.accumulate(np.where(group, i, 0))
            self.levels.append(rank)
            single = part & np.concatenate([part[1:], [True]])
            open_, step = at[~single], 2 * step
        self.isa = rank
        self.sa = np.empty(n, np.int64)
        self.sa[rank] = np.arange(n)

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at p and q (different positions)."""
        last = len(self.symbols) - 1
        p, q, start = p.copy(), q.copy(), p
        p_stop, q_stop = self.stops[p], self.stops[q]
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            same = (p < p_stop) & (q < q_stop) & (level[np.minimum(p, last)] == level[np.minimum(q, last)])
            p, q = p + (same << k), q + (same << k)
        return p - start

    def intervals(self, least: int) -> np.ndarray:
        """The LCP intervals of at least ``least`` suffixes, as rows (depth, first rank, last rank, and first and last rank of the
        largest child)."""
        lcp = np.zeros(len(self.sa) + 1, np.int64)
        near = np.flatnonzero(self.levels[0][self.sa[1:]] == self.levels[0][self.sa[:-1]]) + 1
        lcp[near] = self.common(self.sa[near - 1], self.sa[near])
        out, stack = [], []  # of open intervals: depth, first rank, the largest child so far
        for r, depth in enumerate(lcp.tolist()):
            lo, child = r - 1, None
            while stack and stack[-1][0] > depth:
                d, lo, a, b = stack.pop()
                if r - lo >= least:
                    out.append((d, lo, r - 1, a, b))
                child = (lo, r - 1)
                if stack and stack[-1][0] >= depth:
                    top, child = stack[-1], None
                    if r - 1 - lo > top[3] - top[2]:
                        top[2], top[3] = lo, r - 1
            if depth and (not stack or stack[-1][0] < depth):
                stack.append([depth, lo, *(child or (lo, lo))])
        return np.array(out, np.int64).reshape(-1, 5)


def branching_squares(s: SuffixArray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(end, depth) of the squares that no shift to the right leaves a square: two adjacent words sequences of ``depth`` words,
    ending before ``end``. Every run ends in one whose depth is the run's period.

    Of an interval of depth d, positions i and i + d in different children are such a square. One of them is outside the largest
    child, so only the suffixes of the smaller children look for i + d and i - d among the interval's ranks. Intervals of fewer
    than ``least`` suffixes are left out: all periods of a run but the last begin with the same words.
    """
    depth, lo, hi, a, b = s.intervals(least).T
    left, right = a - lo, hi - b
    node = np.repeat(np.arange(len(depth)), left + right)
    nth = np.arange(len(node)) - np.repeat(np.cumsum(left + right) - left - right, left + right)
    i = s.sa[np.where(nth < left[node], lo[node] + nth, b[node] + 1 + nth - left[node])]
    d = depth[node]
    found = []
    for first, other, there in ((i, i + d, i + d < s.stops[i]), (i - d, i - d, i - d >= starts[i])):
        rank = s.isa[np.where(there, other, 0)]
        hit = there & (rank >= lo[node]) & (rank <= hi[node])
        first, period = first[hit], d[hit]
        end = first + 2 * period
        stop = s.stops[first]
        branch = (end >= stop) | (s.symbols[first + period] != s.symbols[np.minimum(end, len(s.symbols) - 1)])
        found.append(np.stack([end, period])[:, branch])
    return tuple(np.unique(np.concatenate(found, axis=1), axis=1))


def _left(symbols: np.ndarray, at: int, period: int, start: int) -> int:
    """The first position from which the period holds up to ``at``, not before ``start``."""
    size = 64
    while at > start:
        lo = max(start, at - size)
        differs = np.flatnonzero(symbols[lo:at] != symbols[lo + period : at + period])
        if len(differs):
            return lo + int(differs[-1]) + 1
        at, size = lo, 2 * size
    return at


def word_runs(symbols: np.ndarray, first: np.ndarray, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of all texts, by start, then period. first: where each text begins in ``symbols``, and
    the end. A symbol belongs to one text; min_exponent is 2 or more."""
    sizes = np.diff(first)
    starts, stops = np.repeat(first[:-1], sizes), np.repeat(first[1:], sizes)
    if not len(symbols):
        return []
    s = SuffixArray(symbols, stops)
    end, period = branching_squares(s, starts, min_exponent)
    # long enough: the period holds from end - need on
    need = np.maximum(min_words, min_exponent * period)
    from_ = end - need
    begin = starts[end - 1]
    end, period, from_, begin, need = (x[from_ >= begin] for x in (end, period, from_, begin, need))
    long = s.common(from_, from_ + period) >= need - period
    out, known, last = [], [], -1
    for e, q, x, b in zip(*(v[long].tolist() for v in (end, period, from_, begin)), strict=True):  # by end, then period
        if e != last:
            known, last = [], e
        if any(q % p == 0 and at <= e - 2 * q for p, at in known):
            continue  # a square of shorter periods
        at = _left(symbols, x, q, b)  # the squares rotate to the left
        known.append((q, at))
        out.append((at, e - at, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _texts(c: Chunk, runs: list[tuple[int, int, int]]) -> Iterator[tuple[list[dict], bytes]]:
    """Of each text its runs, and the words left when every run keeps its first period."""
    k = 0
    for i in range(len(c.first) - 1):
        own, words, base = [], c.text(i).split(), int(c.first[i])
        while k < len(runs) and runs[k][0] < c.first[i + 1]:
            own.append({"start": runs[k][0] - base, "length": runs[k][1], "period": runs[k][2]})
            k += 1
        if own:
            edge = np.zeros(len(words) + 1, np.int64)
            for r in own:
                edge[r["start"] + r["period"]] += 1
                edge[r["start"] + r["length"]] -= 1
            words = [words[j] for j in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]
        yield own, b" ".join(words)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """(id_col, runs, collapsed): one row for each row of ``docs``.

    A run is a stretch of consecutive words in which words ``period`` apart are identical, of at least ``min_words`` words and
    ``min_exponent`` periods (2 or more), which no neighbouring word extends; the period is the smallest. ``runs`` has
    (start, length, period), words from 0, by start, then period. ``collapsed`` are the words that no run contains after its
    first period, joined by one space.

    Words are told apart by 64-bit hashes within a text. Null and blank texts have no words: no run, an empty text. Null ids
    and repeated rows are rows like others. Long texts are worked alone, with memory for a dozen numbers a word. Empty table:
    empty result. Other columns are not carried, so their names cannot clash.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1)):
                own = word_hashes(c.data, c.starts, c.ends) + c.doc_of_word().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                symbols = np.unique(mix(own), return_inverse=True)[1].astype(np.int64)
                runs, left = zip(*_texts(c, word_runs(symbols, c.first, min_words, min_exponent)), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0)[c.lo : c.hi], pa.array(runs, pa.list_(RUN)), pa.array([t.decode() for t in left], pa.string())], names=["id", "runs", "collapsed"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(task, f"id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def _planted(doc_id: Column, text: Column) -> Column:
    """The text whose tail is periodic where the id's checksum says so (fixed by the query's contract)."""
    n = word_count(text)
    words = F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), SPACES)
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    whole = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
    tail = F.slice(whole, 1, (n - a).cast("int"))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, 1, a.cast("int")), tail), " ")).otherwise(text)


def op13(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", _planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(docs)
    best = F.expr("aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (b, r) -> CASE WHEN b IS NULL OR r.length > b.length THEN r ELSE b END)")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period"))
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: Runs by self-joins: words q apart that agree over five words, gathered into stretches; the shortest period of a stretch stays.
ORACLE = r"""
WITH t AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
s AS (SELECT d.doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
             xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t.crc[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS h
      FROM documents d, t),
u AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS hit, h // 10 AS g FROM s),
v AS (SELECT *, CASE WHEN hit THEN g % n END AS a FROM u),
x AS (SELECT *, CASE WHEN hit THEN 1 + (n - a) // (3 + g % 8) END AS p FROM v),
y AS (SELECT doc_id, n, CASE WHEN hit THEN list_transform(range(n), lambda i: CASE WHEN i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END) ELSE w END AS w FROM x),
k AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM y),
five AS (SELECT doc_id, n, i, word, lead(word, 1) OVER o AS w1, lead(word, 2) OVER o AS w2, lead(word, 3) OVER o AS w3, lead(word, 4) OVER o AS w4
         FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM five a JOIN five b USING (doc_id, word, w1, w2, w3, w4)
          WHERE a.w4 IS NOT NULL AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
isles AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM pairs),
alike AS (SELECT doc_id, q, min(i) AS start, count(*) + 4 + q AS length FROM isles GROUP BY doc_id, q, isle),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM alike WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
gone AS (SELECT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
edge AS (SELECT DISTINCT doc_id, i FROM gone),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM k ANTI JOIN edge USING (doc_id, i) GROUP BY doc_id),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) AS r FROM runs),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS text FROM runs GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
       (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(listed.text, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM documents LEFT JOIN listed USING (doc_id) LEFT JOIN (SELECT * FROM best WHERE r = 1) b USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
