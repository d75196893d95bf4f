"""Line dedup by range-partitioned line hashes and per-document keep bitmaps. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, staged


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")))


def split_lines(text: Column) -> Column:
    """Null counts as one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Bitmaps of dropped lines, instead of text: (id, rk, n_dropped, words), only for rows that lose a line.

    A line is dropped if its key has at least ``min_chars`` code points and is found in at least ``min_docs``
    documents (distinct ids). ``rk`` is the text's hash: rows that share an id but not the text have their own
    bitmap. ``words`` holds only the 64-line words with a dropped line, as (word, bits) in order.

    Hashes are range-partitioned together with the document, so one line found everywhere spreads over many
    partitions. Within them rows are sorted by hash, document and position, and a window that needs just this
    order streams over them: the first occurrence of each (hash, document) counts as one document.

    Null or empty text is one empty line; null ids are one document. Empty table: empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("rk"), F.posexplode(split_lines(F.col(text_col))).alias("pos", "line"))
    key = line_key(F.col("line"))
    rows = rows.withColumn("key", key).where(F.length("key") >= min_chars)
    rows = staged(rows.select(F.xxhash64("key").alias("h"), F.hash("key").alias("g"), "id", "rk", "pos"), "lines")
    common = staged(first_occurrences(rows).groupBy("h", "g").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs).select("h", "g"), "common-lines")
    gone = rows.join(common.hint("merge"), ["h", "g"])
    word = F.floor(F.col("pos") / 64).cast("int")
    bits = gone.groupBy("id", "rk", word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return bits.groupBy("id", "rk").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"), F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"))


def first_occurrences(rows: DataFrame) -> DataFrame:
    """(h, g, id, pos): the row of smallest pos of each (h, g, id)."""
    ranged = rows.select("h", "g", "id", "pos").repartitionByRange("h", "g", "id").sortWithinPartitions("h", "g", "id", "pos")
    nth = F.row_number().over(Window.partitionBy("h", "g", "id").orderBy("pos"))
    return ranged.withColumn("nth", nth).where("nth = 1").drop("nth")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, text, lines, kept, n_dropped) for each row of ``docs``: all its columns as a struct, so that no name
    clashes, all lines, those that stay, and how many do not."""
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("rk"))
    marks = bitmaps.select(F.col("id").alias("mark_id"), F.col("rk").alias("mark_rk"), "words", F.col("n_dropped").alias("n"))
    found = rows.join(marks.hint("merge"), F.col("id").eqNullSafe(F.col("mark_id")) & (F.col("rk") == F.col("mark_rk")), "left")
    # words without a dropped line are put back, so that a line's bit is found by its position
    dense = F.expr("flatten(transform(words, (x, i) -> concat(array_repeat(0L, x.word - coalesce(get(words, i - 1).word, -1) - 1), array(x.bits))))")
    found = found.withColumn("lines", split_lines(F.col("text"))).withColumn("dense", dense)
    kept = F.expr("filter(lines, (x, i) -> coalesce(getbit(get(dense, cast(i div 64 as int)), i % 64), 0) = 0)")
    kept = F.when(F.col("words").isNull(), F.col("lines")).otherwise(kept)
    return found.select("row", "id", "text", "lines", kept.alias("kept"), F.coalesce("n", F.lit(0).cast("long")).alias("n_dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with the text that is left, under the same columns. Every row stays, also with an empty text.

    Null or empty text is one empty line; a null text without dropped lines stays null. Null ids are one
    document. Rows repeated in full count as one document and lose the same lines. Long texts only make longer
    bitmaps. Empty table: empty result. Other columns are carried, whatever their names.
    """
    marked = apply_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, min_docs, min_chars), id_col, text_col)
    left = F.when(F.col("n_dropped") > 0, F.array_join("kept", "\n")).otherwise(F.col("text"))
    return marked.select(*((left if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = apply_bitmaps(docs, keep_bitmaps(docs))
    return marked.select(F.col("id").alias("doc_id"), F.size("lines").cast("long").alias("n_lines"), "n_dropped", F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
k AS (SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (c.key IS NOT NULL)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY doc_id
"""
