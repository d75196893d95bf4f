"""Sharding by proportional stratified interleaving. DataFrame operations only.

Two sorts by range give every row its place: first within its source, then among all. Both carry ids and numbers, never
texts, and each row's place in a sorted partition plus the rows of the partitions before it is its place in all, so no
source and no shard meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierstats.sources.shared import discard

from .common import lookup_join, staged
from .mixing import hash60

#: Rows of a sorted partition; with them the number of partitions grows with the table.
PART_ROWS = 1 << 18


def _sorted(rows: DataFrame, order: list[str], n_rows: int, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """``rows`` with ``place``, their number from 0 in the total order by ``order``, whose values are all different; and the tables that
    are read for it.

    A task numbers its own rows by monotonically_increasing_id, whose high bits are the partition and whose low 33 bits
    count its rows; partitions are in order. The numbered rows are written before they are counted, so the
    counts are of the very partitions that were numbered.
    """
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(max(spread, -(-n_rows // PART_ROWS)), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    numbered = staged(ranged.withColumn("_at", at).withColumn("_part", F.shiftright("_at", 33)), name)
    # one row a partition
    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    starts = staged(starts, f"{name}-starts")
    placed = lookup_join(numbered, starts, "_part")
    return placed.withColumn("place", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_before"), [numbered, starts]


def interleave(docs: DataFrame, n_shards: int, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", extra: dict[str, Column] | None = None) -> DataFrame:
    """(id_col, source, shard, slot, place, then ``extra``): one row for each row of ``docs``.

    Rows of a source are shuffled by a seeded hash of id and text and ranked; all rows are sorted by fractional rank,
    (rank + 1/2) / rows of the source, which spreads each source evenly over the whole order. ``place`` is the row's number in
    that order and is cut into ``n_shards`` shards of row counts at most one apart, so a shard holds every source in its share
    of all rows, but for a row or so. ``slot`` counts a shard's rows from 0; reading shards by slot keeps the mixture
    at every moment. The order of equal fractions is that of the sources, null last.

    extra: further output columns, by name, made of columns of ``docs``.

    Null source: a source of its own. Null text and null id: hashed as empty. Rows repeated in full have one hash
    and stand side by side, in order of the table's files; they are interchangeable, so which of them takes which slot says
    nothing. Long texts are hashed, not moved. Empty table: empty result. Other columns are not carried, so their names
    cannot clash.
    """
    spark = docs.sparkSession
    more = extra or {}
    own = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), hash60(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"),
        F.monotonically_increasing_id().alias("nth"), F.struct(*(c.alias(name) for name, c in more.items()) if more else (F.lit(0).alias("_"),)).alias("extra"),
    )
    rows = staged(own.withColumn("last", F.col("source").isNull()), "shard-rows")
    totals = rows.groupBy("source", "last").agg(F.count(F.lit(1)).alias("size"))
    # one row a source
    upto = Window.partitionBy(F.lit(0)).orderBy("last", "source").rowsBetween(Window.unboundedPreceding, -1)
    totals = staged(totals.select(F.col("source").alias("s"), "size", F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("before")), "shard-totals")
    n = totals.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ranked, read = _sorted(rows, ["last", "source", "h", "nth"], n, "shard-ranks")
    ranked = lookup_join(ranked, totals, F.col("source").eqNullSafe(F.col("s")))
    fraction = (2 * (F.col("place") - F.col("before")) + 1) / (2 * F.col("size"))
    order = ranked.select("id", "source", "last", "extra", fraction.alias("fraction"), F.col("place").alias("rank"))
    placed, _ = _sorted(order, ["fraction", "last", "source", "rank"], n, "shard-order")
    for done in (rows, totals, *read):
        discard(spark, done)
    # shard k holds the places from ceil(k n / shards) on
    shard = F.expr(f"(place * {int(n_shards)}L) div {max(n, 1)}L")
    start = F.expr(f"(shard * {max(n, 1)}L + {int(n_shards) - 1}L) div {int(n_shards)}L")
    out = placed.withColumn("shard", shard).withColumn("slot", F.col("place") - start)
    return out.select(F.col("id").alias(id_col), "source", F.col("shard").cast("int").alias("shard"), "slot", "place", *(F.col(f"extra.{name}").alias(name) for name in more))


def op12(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    found = interleave(docs, 24, extra={"size": F.octet_length(text).cast("long") + 8, "text_crc32": F.crc32(text)})
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The same order by two windows; checksums byte by byte.
ORACLE = r"""
WITH t AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
d AS (SELECT doc_id, source, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 8 AS size,
             ('0x' || substr(md5('0 ' || coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')), 1, 15))::BIGINT AS h
      FROM documents),
b AS (SELECT *, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM d),
c AS (SELECT doc_id, source, size, h, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, t.crc[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32 FROM b, t),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * rank + 1)::DOUBLE / (2 * n)::DOUBLE, source NULLS LAST, rank) - 1 AS place, count(*) OVER () AS total FROM r),
s AS (SELECT *, place * 24 // total AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, shard::INT AS shard, (place - (shard * total + 23) // 24)::BIGINT AS slot, NULL::INT AS grown_shard FROM s
"""
