"""Substring dedup by relative Lempel-Ziv parsing against an index of reference blocks.

A window is ``window`` consecutive words. Its anchor is the leftmost smallest hash of the anchor-length word sequences
in it, so equal windows have equal anchors at equal places, and a text falls into blocks: the longest runs of
consecutive windows with one anchor. The blocks of all texts are the reference index, each with how often it stands
and its first and last place.

Each text is then parsed from left to right. At a block that stands elsewhere too a factor begins; of the block's
reference places (other than its own) the one is taken from which the match goes on furthest, block by block, and the
factor ends where that reference ends. Factors span ``window`` words at least, so they are duplicate spans. What is left
are factor boundaries: blocks that share an anchor with others but not all words, as where a repeated passage begins and
ends. There each window is looked up by itself, once for each distinct block, and runs of windows found are factors too.

So it is exact, while only one row for about fourteen words is ever shuffled, and copies add to counts instead of
rows. Equal texts are parsed once. Texts, blocks and windows are told apart by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierstats.sources.shared import discard, shared_dir

from .common import staged
from .words import WINDOW_BASE_2, WORD_BASE, WORD_BASE_2, chunks, mix, whole_windows, window_hashes, word_hashes

#: Words of an anchor, where the window is neither shorter nor above 70 words (a block's windows must fit a mask).
ANCHOR = 8
#: Most buckets that Spark allows a table.
MAX_BUCKETS = 100_000


def anchor_words(window: int) -> int:
    return max(min(ANCHOR, window), window - 62)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=3)
    for b in batches:
        packed = [z.compress(t.as_py()) for t in b.column(2).cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], names=["t1", "t2", "z"])


def _unpacked(column: pa.Array) -> pa.Array:
    z = zstandard.ZstdDecompressor()
    return pa.array([z.decompress(x.as_py()) for x in column], pa.large_binary())


def _cut(c, window: int) -> tuple[np.ndarray, ...]:
    """Of each block: its first window's word, its number of windows, its text in the chunk, anchor and two block hashes."""
    none = np.zeros(0, np.int64)
    at = whole_windows(c.first, window)
    if not len(at):
        return none, none, none, none, none, none
    k = anchor_words(window)
    h, h2 = (word_hashes(c.data, c.starts, c.ends, base) for base in (WORD_BASE, WORD_BASE_2))
    a = window_hashes(h, k)
    low = sliding_window_view(a, window - k + 1).argmin(axis=1)[at] + at
    new = np.flatnonzero(np.diff(low, prepend=-1))
    start, end = at[new], at[np.append(new[1:], len(at)) - 1]
    n_windows = end - start + 1
    block, block2 = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
    sizes = n_windows + window - 1
    for size in np.unique(sizes).tolist():  # at most one size a place of the anchor
        own = np.flatnonzero(sizes == size)
        block[own] = window_hashes(h, size)[start[own]]
        block2[own] = window_hashes(h2, size, WINDOW_BASE_2)[start[own]]
    anchor, sized = a[low[new]], sizes.astype(np.uint64)
    doc = np.searchsorted(c.first, start, "right") - 1
    return start - c.first[doc], n_windows, doc, anchor.view(np.int64), mix(block ^ sized).view(np.int64), mix(block2 ^ sized).view(np.int64)


def _blocks(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t1, t2, copies = (np.asarray(b.column(i)) for i in (0, 1, 2))
            for c in chunks(_unpacked(b.column(3))):
                start, n, doc, anchor, b1, b2 = _cut(c, window)
                doc = c.lo + doc
                cols = [anchor, b1, b2, t1[doc], t2[doc], start << 8 | n, copies[doc]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["anchor", "b1", "b2", "t1", "t2", "at", "n"])

    return run


def _boundary_windows(window: int):
    """(t1, t2, z, need: array of (at, b1, b2, n)) -> one row for each window of the blocks in need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in chunks(_unpacked(b.column(2))):
                need = b.column(3)[c.lo : c.hi]
                doc = np.repeat(np.arange(len(need)), np.diff(np.asarray(need.offsets)))
                at, b1, b2, n = (np.asarray(x) for x in need.flatten().flatten())
                w1 = window_hashes(word_hashes(c.data, c.starts, c.ends), window)
                w2 = window_hashes(word_hashes(c.data, c.starts, c.ends, WORD_BASE_2), window, WINDOW_BASE_2)
                size = at & 255
                place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                word = np.repeat(c.first[doc] + (at >> 8), size) + place
                cols = [w1[word].view(np.int64), w2[word].view(np.int64), np.repeat(b1, size), np.repeat(b2, size), place, np.repeat(n, size)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["w1", "w2", "b1", "b2", "place", "n"])

    return run


def parse(text: int, at: np.ndarray, mask: np.ndarray, refs: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """Factors (start word, end word, reference text, its start word) of a text, from its blocks that have a mask, in order.

    refs: first and last place of each block, as rows (text, at, text, at). Whole blocks (mask -1) are factored greedily;
    runs of single windows have no reference (0, -1).
    """
    start, size = at >> 8, at & 255
    out = []
    whole = np.flatnonzero(mask == -1)
    s, n, r = start[whole], size[whole], refs[whole]
    go_on = []  # for either reference: up to which block the match goes on
    for i in (0, 2):
        place = r[:, i + 1] >> 8
        on = (s[1:] == s[:-1] + n[:-1]) & (r[1:, i] == r[:-1, i]) & (place[1:] - place[:-1] == s[1:] - s[:-1])
        ends = np.append(np.flatnonzero(~on), len(s) - 1)
        go_on.append(ends[np.searchsorted(ends, np.arange(len(s)))] if len(s) else ends)
    i = 0
    while i < len(s):
        best = [(go_on[k][i], -k, k) for k in (0, 1) if r[i, 2 * k] != text or r[i, 2 * k + 1] >> 8 != s[i]] or [(go_on[0][i], 0, 0)]  # copies of the text refer to its own place
        last, _, k = max(best)
        out.append((int(s[i]), int(s[last] + n[last] + window - 1), int(r[i, 2 * k]), int(r[i, 2 * k + 1] >> 8)))
        i = last + 1
    for j in np.flatnonzero(mask != -1):
        bits = np.flatnonzero(int(mask[j]) >> np.arange(size[j]) & 1)
        for run in np.split(bits, np.flatnonzero(np.diff(bits) > 1) + 1):
            out.append((int(start[j] + run[0]), int(start[j] + run[-1] + window), 0, -1))
    return sorted(out)


FACTOR = "array<struct<start:long,end:long,ref:long,ref_start:long>>"
_FACTOR = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "end", "ref", "ref_start")]))
KEPT = f"t1 long, t2 long, n_words long, n_removed long, kept_sha256 string, kept string, factors {FACTOR}"


def _strip(window: int, with_text: bool):
    """(t1, t2, z, spans: array of (at, mask, first and last place)) -> what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, digests, texts, factors = [], [], [], [], []
            spans = b.column(3)
            fields = [np.asarray(x) for x in spans.flatten().flatten()]
            ends = np.cumsum(np.asarray(spans.value_lengths().fill_null(0)))
            for i, raw in enumerate(_unpacked(b.column(2))):
                words = raw.as_py().split()  # bytes.split() cuts at the six ASCII spaces
                n_words.append(len(words))
                own = slice(int(ends[i - 1]) if i else 0, int(ends[i]))
                found = []
                if own.stop > own.start:
                    order = np.argsort(fields[0][own], kind="stable")
                    at, mask, *places = (x[own][order] for x in fields)
                    found = parse(b.column(0)[i].as_py(), at, mask, np.stack(places, axis=1), window)
                    edge = np.zeros(len(words) + 1, np.int64)
                    for start, end, *_ in found:
                        edge[start] += 1
                        edge[end] -= 1
                    words = [words[j] for j in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                n_removed.append(n_words[-1] - len(words))
                kept = b" ".join(words)
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode() if with_text else None)
                factors.append([dict(zip(("start", "end", "ref", "ref_start"), f, strict=True)) for f in found] if with_text else None)
            cols = [b.column(0), b.column(1), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string()), pa.array(factors, _FACTOR)]
            yield pa.RecordBatch.from_arrays(cols, names=["t1", "t2", "n_words", "n_removed", "kept_sha256", "kept", "factors"])

    return run


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, with_text: bool = True) -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256, kept, factors), one row for each row of ``docs``.

    Words covered by a window whose word sequence starts anywhere else, in the same text or another, are removed;
    windows are judged on the input. ``kept`` is the rest, joined by one space, and ``factors`` the duplicate spans by
    word, with the reference text's hash and start, where one was followed (both null unless ``with_text``).

    Null text has no words. Rows repeated in full count as separate places, so their long texts go. Null ids keep a
    row each. Long texts are read whole. Empty table: empty result. Other columns are not carried, so their names cannot
    clash.

    Texts go compressed into a table in the shared folder, bucketed by their hash, so the two later passes over them need
    no shuffle; it has at least as many buckets as the input has files, so buckets stay of one size as the input grows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.lit(0), text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))
    packed = rows.select("t1", "t2", "text").mapInArrow(_pack, "t1 long, t2 long, z binary")
    name = f"texts_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(MAX_BUCKETS // parts, -(-len(docs.inputFiles()) // parts)) * parts or parts
    # copies meet as one row for each map task, not as a row for each copy
    whole = packed.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n"), F.first("z").alias("z"))
    whole.write.option("path", f"{shared_dir(spark)}/{name}").bucketBy(buckets, "t1", "t2").saveAsTable(name)
    try:
        stripped = _stripped(spark.table(name), window, with_text)
    finally:
        spark.sql(f"DROP TABLE {name}")
        discard(spark, f"{shared_dir(spark)}/{name}")
    out = rows.select("id", "t1", "t2").join(stripped.hint("merge"), ["t1", "t2"])
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256", "kept", "factors")


def _stripped(texts: DataFrame, window: int, with_text: bool) -> DataFrame:
    """texts (t1, t2, n, z), one row a text -> the written table of KEPT."""
    spark = texts.sparkSession
    longs = lambda *names: ", ".join(f"{x} long" for x in names)
    blocks = staged(texts.select("t1", "t2", "n", "z").mapInArrow(_blocks(window), longs("anchor", "b1", "b2", "t1", "t2", "at", "n")), "rlz-blocks")
    shared = staged(blocks.groupBy("anchor").agg(F.sum("n").alias("c")).where("c >= 2").select("anchor"), "rlz-anchors")
    found = staged(blocks.join(shared.hint("merge"), "anchor"), "rlz-shared")
    discard(spark, blocks)
    place = F.struct("t1", "t2", "at")
    index = staged(found.groupBy("anchor", "b1", "b2").agg(F.sum("n").alias("n"), F.min(place).alias("first"), F.max(place).alias("last")), "rlz-index")

    # factor boundaries: blocks of an anchor that has several, one of them found once
    unlike = index.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("least")).where("c >= 2 and least = 1").select("anchor")
    unlike = staged(unlike, "rlz-unlike")
    need = index.join(unlike.hint("merge"), "anchor").select("first.t1", "first.t2", F.struct("first.at", "b1", "b2", "n").alias("x")).groupBy("t1", "t2").agg(F.collect_list("x").alias("need"))
    checked = texts.select("t1", "t2", "z").join(need.hint("merge"), ["t1", "t2"]).select("t1", "t2", "z", "need")
    windows = staged(checked.mapInArrow(_boundary_windows(window), longs("w1", "w2", "b1", "b2", "place", "n")), "rlz-windows")
    # what is joined to rows with hot keys is written first: between two plain exchanges Spark splits hot partitions
    twice = staged(windows.groupBy("w1", "w2").agg(F.sum("n").alias("c")).where("c >= 2").select("w1", "w2"), "rlz-twice")
    partial = windows.join(twice.hint("merge"), ["w1", "w2"]).groupBy("b1", "b2").agg(F.bit_or(F.expr("shiftleft(1L, cast(place as int))")).alias("mask"))
    partial = index.where("n = 1").select("b1", "b2", *_places()).join(staged(partial, "rlz-partial").hint("merge"), ["b1", "b2"])
    whole = index.where("n >= 2").select("b1", "b2", *_places(), F.lit(-1).cast("long").alias("mask"))
    masks = staged(whole.unionByName(partial), "rlz-masks")
    discard(spark, windows)

    span = F.struct("at", "mask", "first_text", "first_at", "last_text", "last_at")
    spans = found.join(masks.hint("merge"), ["b1", "b2"]).select("t1", "t2", span.alias("s")).groupBy("t1", "t2").agg(F.collect_list("s").alias("spans"))
    parsed = texts.select("t1", "t2", "z").join(spans.hint("merge"), ["t1", "t2"], "left").select("t1", "t2", "z", "spans")
    stripped = staged(parsed.mapInArrow(_strip(window, with_text), KEPT), "rlz-kept")
    for done in (shared, found, index, unlike, twice, masks):
        discard(spark, done)
    return stripped


def _places() -> list:
    return [F.col("first.t1").alias("first_text"), F.col("first.at").alias("first_at"), F.col("last.t1").alias("last_text"), F.col("last.at").alias("last_at")]


def op4(spark, sf_dir: str) -> DataFrame:
    return strip_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False).drop("kept", "factors")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], chr(10))) AS h FROM d, generate_series(1, len(w) - 34) AS t(i)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM g) WHERE n >= 2),
c AS (SELECT DISTINCT doc_id, i + o AS p FROM r, generate_series(0, 34) AS t(o)),
a AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT a.doc_id, count(c.p)::BIGINT AS n_removed, coalesce(string_agg(x, ' ' ORDER BY a.p) FILTER (c.p IS NULL), '') AS kept
      FROM a LEFT JOIN c ON c.doc_id = a.doc_id AND c.p = a.p GROUP BY a.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
