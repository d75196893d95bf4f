"""Mixing sources to target weights by nested hash-threshold histograms. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tierstats.sources.shared import discard

from .common import lookup_join, staged, word_count

#: Hash digits: md5's first 15 hex digits are 60 bits, refined 12 bits at a time.
HASH_BITS, LEVEL_BITS = 60, 12
#: Rows of one hash that a task numbers.
TIED_ROWS = 100_000


def hash60(*cols: Column) -> Column:
    """A hash in [0, 2^60) that other engines can compute too."""
    text = F.concat_ws(" ", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights: Sequence[float], max_ratio: float) -> DataFrame:
    """totals: (source, source_size), one row a source. Adds ``target``.

    Sources in code-point order, null last, take the weights in turn. Sharing the total by weight, stopping at
    ``max_ratio`` times the own size and resharing the excess has a closed form: with sources ordered by
    cap / weight, a prefix is full and the rest share what is left by weight. The two windows run over one row
    a source.
    """
    order = W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("w", w).withColumn("cap", F.lit(float(max_ratio)) * F.col("source_size"))
    fill = W.partitionBy(F.lit(0)).orderBy(F.expr("cap / w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    rest = fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = F.sum("source_size").over(W.partitionBy(F.lit(0)))
    # the level if this source were the first that is not full
    level = (everything - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    ranked = ranked.withColumn("level", level).withColumn("open", F.col("cap") > F.col("level") * F.col("w"))
    ranked = ranked.withColumn("final", F.min(F.struct(~F.col("open"), F.expr("cap / w"), F.col("source").isNull(), F.col("source"), F.col("open"), F.col("level"))).over(W.partitionBy(F.lit(0))))
    full = F.when(F.col("final.open"), F.least("cap", F.col("final.level") * F.col("w"))).otherwise(F.col("cap"))
    return ranked.select("source", "source_size", full.alias("target"))


def hash_thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """For each source ``copies`` (whole passes) and ``threshold``: documents whose hash is below it count once
    more, so that the source's words come as near its target as whole documents allow. Where the budget ends among rows
    of one hash, which have the same id and text, ``tied`` is the hash and ``some`` how many of them count once more.

    Each level sums words by source and hash bucket, finds the bucket in which the budget ends and refines only
    that bucket; it stops where the bucket holds one document, or rows of one hash.
    """
    state = targets.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    state = state.withColumn("need", F.col("target") - F.col("copies") * F.col("source_size"))
    none = F.lit(None).cast("long")
    state = state.withColumns({"lo": F.lit(0).cast("long"), "base": F.lit(0).cast("long"), "tied": none, "some": none, "threshold": F.when((F.col("need") <= 0) | (F.col("source_size") == 0), F.lit(0)).cast("long")})
    state = staged(state, "mix-state")
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        # the mark of "no open source left" is read from a table of one row a source
        todo = state.where("threshold is null").select(F.col("source").alias("s"), "lo", "base", "need")
        if todo.isEmpty():
            break
        width = 1 << shift
        inside = lookup_join(sized, todo, F.col("source").eqNullSafe(F.col("s")))
        inside = inside.where((F.col("h") >= F.col("lo")) & (F.col("h") < F.col("lo") + F.lit(width << LEVEL_BITS)))
        bucket = F.shiftright(F.col("h") - F.col("lo"), shift)
        hist = inside.groupBy("s", "lo", "base", "need", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        upto = W.partitionBy("s").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
        hist = hist.withColumn("cum", F.col("base") + F.sum("words").over(upto)).where("cum > need")
        edge = hist.withColumn("rank", F.row_number().over(W.partitionBy("s").orderBy("bucket"))).where("rank = 1")
        start = F.col("lo") + F.col("bucket") * F.lit(width)
        before = F.col("cum") - F.col("words")
        settled = (F.col("n") == 1) | F.lit(shift == 0)
        nearer = F.col("cum") - F.col("need") < F.col("need") - before
        several = settled & (F.col("n") > 1)
        # rows of one hash are of one size: the last that fits, and one more if that comes nearer
        each, rest = F.col("words") / F.col("n"), F.col("need") - before
        fit = F.floor(rest / each)
        some = fit + F.when((fit + 1) * each - rest < rest - fit * each, 1).otherwise(0)
        edge = edge.select(
            F.col("s").alias("source"), start.alias("new_lo"), before.alias("new_base"), F.when(several, start).alias("new_tied"), F.when(several, some).alias("new_some"),
            F.when(settled, F.when(nearer & ~several, start + F.lit(width)).otherwise(start)).alias("new_threshold"), F.lit(True).alias("hit"),
        )
        edge = staged(edge, "mix-edge")
        old = state.alias("a").join(F.broadcast(edge).alias("b") if edge.count() <= 100_000 else edge.alias("b").hint("merge"), F.col("a.source").eqNullSafe(F.col("b.source")), "left")
        # no bucket passes the budget: rounding left need at the whole size, so every document counts
        passed = F.when(F.col("b.hit"), F.col("b.new_threshold")).otherwise(F.lit(1 << HASH_BITS))
        last = state
        state = staged(old.select(
            "a.source", "a.source_size", "a.target", "a.copies", "a.need",
            F.coalesce("b.new_lo", "a.lo").alias("lo"), F.coalesce("b.new_base", "a.base").alias("base"), F.coalesce("b.new_tied", "a.tied").alias("tied"), F.coalesce("b.new_some", "a.some").alias("some"),
            F.when(F.col("a.threshold").isNotNull(), F.col("a.threshold")).otherwise(passed).alias("threshold"),
        ), "mix-state")
        for done in (last, edge):
            discard(sized.sparkSession, done)
    return state.select("source", "source_size", "target", "copies", "threshold", "tied", "some")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    text = F.col(text_col)
    return [F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), hash60(F.col(id_col), text).alias("h")]


def _apply(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``sized`` with n_copies and taken. Only the rows of the hashes on which budgets end are numbered, in blocks of TIED_ROWS."""
    out = lookup_join(sized, plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    n = F.col("copies") + (F.col("h") < F.col("threshold")).cast("long")
    if not plan.where("tied is not null").isEmpty():
        on_edge = F.coalesce(F.col("h") == F.col("tied"), F.lit(False))
        edge = staged(out.where(on_edge).withColumn("nth", F.monotonically_increasing_id()), "mix-tied")  # written, so that the numbers stay
        block = F.pmod(F.xxhash64("nth"), F.lit(max(1, -(-edge.count() // TIED_ROWS))))
        edge = edge.withColumn("block", block)
        blocks = edge.groupBy("source", "block").agg(F.count(F.lit(1)).alias("m"))
        before = F.sum("m").over(W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
        blocks = blocks.select(F.col("source").alias("s"), F.col("block").alias("b"), F.coalesce(before, F.lit(0)).alias("before"))
        rank = F.row_number().over(W.partitionBy("source", "block").orderBy("nth"))
        edge = edge.withColumn("rank", rank).join(blocks.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
        edge = edge.withColumn("one", (F.col("before") + F.col("rank") <= F.col("some")).cast("long"))
        out = out.where(~on_edge).withColumn("n_copies", n).unionByName(edge.withColumn("n_copies", F.col("copies") + F.col("one")).drop("nth", "block", "rank", "s", "b", "before", "one"))
    else:
        out = out.withColumn("n_copies", n)
    return out.withColumn("taken", F.col("n_copies") * F.col("size"))


def mix_plan(sized: DataFrame, weights: Sequence[float], max_ratio: float) -> DataFrame:
    totals = staged(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-totals")
    plan = hash_thresholds(sized, source_targets(totals, weights, max_ratio))  # written
    discard(sized.sparkSession, totals)
    return plan


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), max_ratio: float = 3.0) -> DataFrame:
    """How often each document enters a mix in which sources meet their weights.

    Returns (``id_col``, source, size, source_size, target, n_copies, taken), one row for each row of ``docs``.
    A document's copies are the source's whole passes plus one if its hash is under the source's threshold;
    ``taken`` = copies x size. The hash covers id and text, so reruns agree, in any order and partitioning.

    Null or blank text: size 0, nothing taken. Null source: a source of its own, last in order. Rows that have id and text
    in common share a hash; where the budget ends among them, as many of them are taken as come nearest the target. A source whose documents are all empty has target 0. Empty table: empty
    result. Other columns of ``docs`` are not carried, so their names cannot clash.
    """
    sized = staged(docs.select(*_sized(docs, id_col, text_col, source_col)), "mix-sizes")
    out = _apply(sized, mix_plan(sized, weights, max_ratio))
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "n_copies", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), max_ratio: float = 3.0) -> DataFrame:
    """The documents of the mix of ``mix_sources``: all columns of ``docs`` and n_copies, at least 1.

    Texts are not shuffled: their own hash is compared with the source's threshold.
    """
    sized = staged(docs.select(*_sized(docs, id_col, text_col, source_col)), "mix-sizes")
    own = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), *_sized(docs, id_col, text_col, source_col))
    out = _apply(own, mix_plan(sized, weights, max_ratio)).where("n_copies > 0")
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns if c != "n_copies"), "n_copies")


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


#: The same mix by sorting: cumulative words in hash order for each source.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM t),
c AS (SELECT *, 3.0::DOUBLE * source_size AS cap FROM r),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
f AS (SELECT level FROM l WHERE cap > level * w ORDER BY cap / w, source NULLS LAST LIMIT 1),
g AS (SELECT source, source_size, coalesce(least(cap, (SELECT level FROM f) * w), cap) AS target FROM l),
k AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM g),
n AS (SELECT *, target - copies * source_size AS need FROM k),
q AS (SELECT d.doc_id, d.size, n.source_size, n.target, n.copies, n.need,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
      FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, source_size, target,
       (size * (copies + CASE WHEN need <= 0 THEN 0 WHEN cum <= need THEN 1
                              WHEN cum - size <= need AND cum - need < need - (cum - size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM q
"""
