"""Hard negatives by a secondary-sort shuffle of scored pairs.

Scores are taken by tiles: a block of anchors against a block of rows, as one matrix product. Of a tile only pairs leave that
can be in the result: an anchor's best positives of the tile, and for each of its positives' windows the tile's first negatives.
They meet in the shuffle: keys (anchor, descending score, id) are sorted within partitions by anchor, and an iterator
that keeps a handful of open windows reads them in order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierstats.sources.shared import discard

from .common import lookup_join, staged

#: Rows of a block of candidates, anchors of a block, and anchors worked at once.
BLOCK_ROWS, ANCHOR_ROWS, STRIP = 8192, 1024, 64
#: Components of a block, where vectors are long.
CELLS = 1 << 23
NONE, MOST, MAX = np.iinfo(np.int64).min, 1 << 62, float(np.finfo(float).max)
BLOCK = "block long, n long, ids binary, labels binary, x binary, windows binary"
KEY = ">QQBQ"
SIGN = 1 << 63


def usable(rows: DataFrame, id_col: str, label_col: str, vector_col: str, anchors: Column, scale: float) -> DataFrame:
    """(id, label, x, anchor): one row an id, components as whole numbers (in doubles, which hold them exactly)."""
    kind = rows.schema[label_col].dataType
    label = F.col(label_col).cast("long") if isinstance(kind, T.IntegralType) else F.xxhash64(label_col)
    fit = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # floor gives a long; doubles beyond 2^53 are whole already
    large = F.transform(vector_col, lambda x: F.least(F.greatest(F.lit(float(scale)) * x.cast("double"), F.lit(-MAX)), F.lit(MAX)))
    whole = F.transform(large, lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x))
    out = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).where(fit)
    out = out.select(F.col(id_col).cast("long").alias("id"), F.struct(label.alias("label"), whole.alias("x"), F.coalesce(anchors, F.lit(False)).alias("anchor")).alias("row"))
    return out.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.x", "row.anchor")


def _pack(most: int):
    """Rows (id, label, x, windows) -> blocks of at most ``most`` rows and about CELLS components, sorted by label and id."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId() << 32, 0

        def block(rows: pa.Table) -> pa.RecordBatch:
            nonlocal nth
            rows = rows.combine_chunks()
            order = np.lexsort((rows["id"].to_numpy(), rows["label"].to_numpy()))
            lists = [rows[c].combine_chunks() for c in ("x", "windows")]
            x, windows = (_matrix(c)[order] for c in lists)
            nth += 1
            cells = [rows["id"].to_numpy()[order].tobytes(), rows["label"].to_numpy()[order].tobytes(), x.tobytes(), windows.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([part + nth - 1]), pa.array([len(order)]), *(pa.array([c], pa.binary()) for c in cells)], names=["block", "n", "ids", "labels", "x", "windows"])

        held, n = [], 0
        for b in batches:
            limit = min(most, max(1, CELLS // max(1, int(np.diff(b.column(2).offsets.to_numpy()).max(initial=0)))))
            while b.num_rows:
                if n >= limit:
                    yield block(pa.Table.from_batches(held))
                    held, n = [], 0
                held.append(b.slice(0, limit - n))
                n += held[-1].num_rows
                b = b.slice(held[-1].num_rows)
        if n:
            yield block(pa.Table.from_batches(held))

    return task


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Lists as rows, shorter ones filled up with zeros."""
    sizes, values = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), values.dtype)
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def _unpack(row: dict, prefix: str) -> tuple[np.ndarray, ...]:
    """ids, labels, x, windows of a block."""
    n = row[f"{prefix}n"]
    cells = (np.frombuffer(row[prefix + c], kind).reshape(n, -1) for c, kind in (("ids", np.int64), ("labels", np.int64), ("x", np.float64), ("windows", np.int64)))
    ids, labels, x, windows = cells
    return ids[:, 0], labels[:, 0], x, windows


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers; a vector without a component has zero there. Exact, but
    that what no long holds becomes the nearest of +-2^62."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * d < 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(v) for v in r] for r in m], object).reshape(m.shape) for m in (a, b)]
    return np.array([[max(-MOST, min(MOST, int(sum(p * q for p, q in zip(r, s, strict=True))))) for s in whole[1]] for r in whole[0]], np.int64).reshape(len(a), len(b))


def best(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest entries of each row, ties by smaller id; NONE is no entry."""
    if not s.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = min(k, s.shape[1])
    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    r, c = np.nonzero((s >= least[:, None]) & (s != NONE))
    order = np.lexsort((ids[c], -s[r, c], r))
    r, c = r[order], c[order]
    nth = np.arange(len(r)) - np.searchsorted(r, r)
    return r[nth < k], c[nth < k]


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest score of a negative of a positive: low % to high % of its score."""
    return -(-low * score // 100), high * score // 100


def _positives(k: int):
    """Tiles -> (anchor, score, id): of each tile an anchor's k best rows of its own label."""

    def tile(row: dict) -> Iterator[tuple[np.ndarray, ...]]:
        ids, labels, x, _ = _unpack(row, "a_")
        rid, rlabel, y, _ = _unpack(row, "b_")
        for label in np.unique(labels):
            lo, hi = np.searchsorted(rlabel, label), np.searchsorted(rlabel, label, "right")
            own = np.flatnonzero(labels == label)
            for at in range(0, len(own), STRIP):
                i = own[at : at + STRIP]
                s = scores(x[i], y[lo:hi])
                s[ids[i][:, None] == rid[None, lo:hi]] = NONE
                r, c = best(s, rid[lo:hi], k)
                yield ids[i][r], s[r, c], rid[lo:hi][c]

    return tile


def _negatives(k: int, low: int, high: int):
    """Tiles -> (anchor, score, id): of each tile the first k rows of another label in each window of an anchor."""

    def tile(row: dict) -> Iterator[tuple[np.ndarray, ...]]:
        ids, labels, x, windows = _unpack(row, "a_")
        rid, rlabel, y, _ = _unpack(row, "b_")
        for at in range(0, len(ids), STRIP):
            i = slice(at, at + STRIP)
            s = scores(x[i], y)
            s[labels[i][:, None] == rlabel] = NONE
            found = []
            for j in range(windows.shape[1] // 2):  # pairs of 1 and a score, or 0 and 0
                some, top = windows[i, 2 * j].astype(bool), windows[i, 2 * j + 1]
                bounds = np.array([window(int(t), low, high) for t in top], np.int64).reshape(-1, 2)
                fits = some[:, None] & (s >= bounds[:, :1]) & (s <= bounds[:, 1:])
                found.append(best(np.where(fits, s, NONE), rid, k))
            r, c = np.unique(np.concatenate([np.stack(f) for f in found], axis=1), axis=1) if found else (np.zeros(0, int),) * 2
            yield ids[i][r], s[r, c], rid[c]

    return tile


def _scored(anchors: DataFrame, blocks: DataFrame, n_blocks: int, tile) -> DataFrame:
    """(anchor, score, id) of all tiles. Each block of anchors is sent to every block of rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                for a, s, r in tile(b.slice(i, 1).to_pylist()[0]):
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (a, s, r)], names=["anchor", "score", "id"])

    named = lambda df, p: [F.col(c).alias(p + c) for c in df.columns]
    each = anchors.drop("block").withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    pairs = each.select(*named(each, "a_")).join(blocks.select(*named(blocks, "b_")).hint("merge"), F.col("a_number") == F.col("b_number"))
    return pairs.mapInArrow(task, "anchor long, score long, id long")


def pack_key(anchor: int, score: int, negative: bool, other: int) -> bytes:
    """Bytes in the order of (anchor, descending score, positives first, id)."""
    return struct.pack(KEY, anchor + SIGN, SIGN - 1 - score, negative, other + SIGN)


def mined(keys: Iterator[bytes], positives: int, negatives: int, low: int, high: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Sorted keys -> (anchor, positive, rank, negative, positive's score, negative's score).

    An anchor's first positives open windows; a negative goes to each open window that it is in. A window is closed when it
    is full or the scores have fallen below it, so what is held is a few windows, whatever an anchor's pairs are.
    """
    anchor, seen, open_ = None, 0, []  # of windows: positive, its score, least, greatest, negatives so far
    for key in keys:
        a, s, negative, i = struct.unpack(KEY, key)
        a, s, i = a - SIGN, SIGN - 1 - s, i - SIGN
        if a != anchor:
            anchor, seen, open_ = a, 0, []
        if not negative:
            seen += 1
            if seen <= positives:
                open_.append([i, s, *window(s, low, high), 0])
            continue
        open_ = [w for w in open_ if s >= w[2] and w[4] < negatives]
        for w in open_:
            if s <= w[3]:
                w[4] += 1
                yield a, w[0], w[4], i, w[1], s


OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    rows: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    scale: float = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
) -> DataFrame:
    """For each anchor (rows where ``anchors`` is true) and each of its first ``positives`` rows of the same label, the first
    ``negatives`` rows of another label whose score is between ``low`` % and ``high`` % of the positive's. Scores are inner
    products of the components floor(scale x); higher ones come first, ties by smaller id. Exact: all rows are scored.

    Returns (anchor_id, positive_id, rank, negative_id, positive_score, negative_score), rank from 1; a window without rows
    gives none.

    Rows with a null id, label or vector, or with a null, NaN or infinite component take no part. Rows of one id are one row,
    that of smallest (label, vector). Vectors of other lengths count as filled up with zeros. Labels that are not whole
    numbers are compared by a 64-bit hash, ids are whole numbers. Empty table, or no anchor: empty result. Other columns
    are not carried, so their names cannot clash.
    """
    spark = rows.sparkSession
    own = usable(rows, id_col, label_col, vector_col, anchors, scale)
    packed = own.withColumn("windows", F.array().cast("array<long>"))
    blocks = staged(packed.select("id", "label", "x", "windows").mapInArrow(_pack(BLOCK_ROWS), BLOCK), "mine-blocks")
    # one row a block
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("block")) - 1
    numbers = staged(blocks.select("block").withColumn("number", number.cast("int")), "mine-numbers")
    n_blocks = numbers.count()
    chosen = staged(own.where("anchor").select("id", "label", "x"), "mine-anchors")
    n_anchors = chosen.count()
    if not n_anchors:
        return spark.createDataFrame([], OUT)
    numbered = lookup_join(blocks, numbers, "block").drop("block")

    def grouped(df: DataFrame) -> DataFrame:
        return df.repartition(-(-n_anchors // ANCHOR_ROWS), "id").select("id", "label", "x", "windows").mapInArrow(_pack(ANCHOR_ROWS), BLOCK)

    first = staged(grouped(chosen.withColumn("windows", F.array().cast("array<long>"))), "mine-first")
    near = _scored(first, numbered, n_blocks, _positives(positives))
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    near = staged(near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= positives).select("anchor", "score", "id"), "mine-positives")
    tops = near.groupBy("anchor").agg(F.flatten(F.collect_list(F.array(F.lit(1).cast("long"), F.col("score")))).alias("windows"))
    asked = staged(grouped(chosen.join(tops.hint("merge"), F.col("id") == F.col("anchor"))), "mine-asked")
    discard(spark, first)
    discard(spark, chosen)
    far = _scored(asked, numbered, n_blocks, _negatives(negatives, low, high))
    pairs = near.withColumn("negative", F.lit(False)).unionByName(far.withColumn("negative", F.lit(True)))
    keys = pairs.rdd.map(lambda r: (pack_key(r.anchor, r.score, r.negative, r.id), None))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = keys.repartitionAndSortWithinPartitions(n, lambda key: zlib.crc32(key[:8]))
    return spark.createDataFrame(sorted_.mapPartitions(lambda part: mined((k for k, _ in part), positives, negatives, low, high)), OUT, verifySchema=False)


def op11(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)


ORACLE = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS own, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank, id AS negative_id, positive_score, score AS negative_score
      FROM p JOIN s USING (anchor_id) WHERE NOT own AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
