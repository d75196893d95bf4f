"""Quality rules as a bitmask ledger: every rule once, then versioned policies on the bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .words import chunks, mix, whole_windows, window_hashes, word_hashes

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bangs")


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for c in chunks(b.column(1)):
            d, at = c.data, c.offsets
            n = c.n_words
            head = (d & 0xC0) != 0x80  # one byte of each code point
            space = (d == 0x20) | ((d >= 0x09) & (d <= 0x0D))
            upper, lower = (d >= 0x41) & (d <= 0x5A), (d >= 0x61) & (d <= 0x7A)
            lines, dup = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for i in range(len(n)):
                full = [x for x in c.text(i).split(b"\n") if x.strip()]
                lines[i], dup[i] = len(full), len(full) - len(set(full))
            cols = [n, c.by_doc(head & ~space, at), c.by_doc(SYMBOLS[d], at), dup, _repeated(c), lines, c.by_doc(upper, at), c.by_doc(upper | lower, at), c.by_doc(d == 0x21, at)]
            yield pa.RecordBatch.from_arrays([b.column(0)[c.lo : c.hi], *(pa.array(x.astype(np.int64)) for x in cols)], names=["id", *MEASURES])


def _repeated(c, k: int = 3) -> np.ndarray:
    """Words of each text that lie in a k-word window found twice or more in that text."""
    at = whole_windows(c.first, k)
    if not len(at):
        return np.zeros(len(c.first) - 1, np.int64)
    doc = c.doc_of_word()
    key = mix(window_hashes(word_hashes(c.data, c.starts, c.ends), k)[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(c.first[-1], bool)
    for i in range(k):
        covered[at[twice] + i] = True
    return c.by_doc(covered, c.first)


def share(part: str, of: str, above: float) -> Column:
    """True if part > above x of; a text without any fails no such rule."""
    return F.col(part) > F.lit(above) * F.col(of)




def rules() -> dict[str, tuple[int, Column]]:
    """Rule -> its bit and what fails it; bits are never reused, so old ledgers stay readable. (A function, as columns
    want a session.)"""
    return {
        "few_words": (0, F.col("n_words") < 50),
        "repeated_words": (1, 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "symbols_per_word": (2, share("n_symbols", "n_words", 0.5)),
        "repeated_lines": (3, share("n_dup_lines", "n_lines", 0.5)),
        "short_words": (4, (F.col("n_words") > 0) & (F.col("word_chars") < 2 * F.col("n_words"))),
        "long_words": (5, share("word_chars", "n_words", 25.0)),
        "upper_case": (6, share("n_upper", "n_letters", 0.7)),
        "exclamations": (7, share("n_bangs", "n_words", 0.5)),
        "empty": (8, F.col("n_words") == 0),
    }


BASE = ("few_words", "repeated_words")
#: Policy version -> the rules that reject.
POLICIES = {
    "v1": BASE,
    "v2": (*BASE, "symbols_per_word", "repeated_lines", "short_words", "long_words", "upper_case", "exclamations", "empty"),
}


def mask_of(names) -> int:
    known = rules()
    return sum(1 << known[n][0] for n in names)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, measures, fail_bits): one row for each row of ``docs``, in one pass over the text.

    Bit b of fail_bits is set if the rule of bit b fails. Null text has no word and no line. Repeated rows and
    null ids keep a row each. Empty table: empty result. Other columns are not carried.
    """
    types = ", ".join(f"{m} long" for m in MEASURES)
    id_type = docs.schema[id_col].dataType.simpleString()
    measured = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_measure, f"id {id_type}, {types}")
    bits = sum((F.when(fails, F.lit(1 << bit)).otherwise(F.lit(0)).cast("long") for bit, fails in rules().values()), F.lit(0).cast("long"))
    return measured.withColumn("fail_bits", bits).withColumnRenamed("id", id_col)


def apply_policy(ledger: DataFrame, policy: str = "v2") -> DataFrame:
    """Adds ``kept``: none of the policy's rules fails. Needs the bits alone, not the texts."""
    return ledger.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask_of(POLICIES[policy]))) == 0)


def ablations(ledger: DataFrame, policy: str = "v2") -> DataFrame:
    """(rule, n_failed, n_only): documents that fail a rule, and those that the policy would keep without it.

    Rows are first summed by bit pattern, of which there are at most 2^rules.
    """
    patterns = ledger.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    used = F.col("fail_bits").bitwiseAND(F.lit(mask_of(POLICIES[policy])))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(1 << rules()[n][0]).cast("long").alias("bit")) for n in POLICIES[policy])))
    rows = patterns.select("n", used.alias("used"), each.alias("r"))
    failed = F.col("used").bitwiseAND(F.col("r.bit")) != 0
    return rows.groupBy("r.rule").agg(F.sum(F.when(failed, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("used") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"))


def op7(spark, sf_dir: str) -> DataFrame:
    """The ledger is stored once, in the shared folder; policies read its bits."""
    stored = staged(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), "rule-ledger")
    judged = apply_policy(stored, "v2")
    base_failed = F.col("fail_bits").bitwiseAND(F.lit(mask_of(BASE))) != 0
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), "kept", "fail_bits")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, generate_series AS i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS tri
      FROM d, generate_series(1, len(w) - 2)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, tri) AS n FROM g) WHERE n >= 2),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(l) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(t, '[^!]', '', 'g')) AS n_bangs
  FROM d LEFT JOIN c USING (doc_id)),
b AS (
  SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (n_symbols > 0.5 * n_words)::BIGINT
         + 8 * (n_dup_lines > 0.5 * n_lines)::BIGINT + 16 * (n_words > 0 AND word_chars < 2 * n_words)::BIGINT
         + 32 * (word_chars > 25 * n_words)::BIGINT + 64 * (n_upper > 0.7 * n_letters)::BIGINT
         + 128 * (n_bangs > 0.5 * n_words)::BIGINT + 256 * (n_words = 0)::BIGINT)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""
