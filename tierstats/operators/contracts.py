"""Contracts: checks that raise while the plan runs, and audits that report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if gone := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(gone)}")
    return df


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def grain_check(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` itself; reading it fails if keys repeat. One aggregate by key carries the rows, so the check costs no
    second pass and no window buffer: a repeated key fails as soon as its group is made."""
    rest = [c for c in df.columns if c not in keys]
    row = F.first(F.struct(*rest)) if rest else F.lit(None)
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), row.alias("_r"))
    ok = F.assert_true(F.col("_n") == 1, F.lit(f"repeated key: {', '.join(keys)}"))
    g = g.where(ok.isNull())
    return g.select(*(F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns))


def vocabulary_violations(df: DataFrame, col: str, words: Sequence[str]) -> DataFrame:
    """Values outside the vocabulary with their counts; empty means it holds."""
    return df.where(F.col(col).isNotNull() & ~F.col(col).isin(*words)).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def vocabulary_check(df: DataFrame, col: str, words: Sequence[str]) -> DataFrame:
    ok = F.assert_true(F.col(col).isNull() | F.col(col).isin(*words), F.concat(F.lit("outside the vocabulary: "), F.col(col).cast("string")))
    return df.where(ok.isNull())


def fingerprint_table(df: DataFrame, columns: Sequence[str], portable: bool = False) -> DataFrame:
    """One row: rows, an order-insensitive hash sum and null counts. Equal content gives equal rows.

    portable: the hash is of the values as text, by MD5, so that other engines can form it too; slower."""
    if portable:
        text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns))
        each = F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")
    else:
        each = F.pmod(F.xxhash64(*columns), F.lit((1 << 31) - 1))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(each), F.lit(0)).alias("hash"), *(F.count(F.when(F.col(c).isNull(), 1)).alias(f"null_{c}") for c in columns))


def row_conservation(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: whether two tables hold the same rows on the given columns."""
    a = fingerprint_table(before, columns).select(F.col("n_rows").alias("n_before"), F.col("hash").alias("h1"))
    b = fingerprint_table(after, columns).select(F.col("n_rows").alias("n_after"), F.col("hash").alias("h2"))
    return a.join(F.broadcast(b)).select("n_before", "n_after", (F.col("h1") == F.col("h2")).alias("same"))  # one row each


def znorm_check(norm: DataFrame, instance: str, value: str, z: str, tolerance: float = 1e-9) -> DataFrame:
    """One row: instances whose mean or SD of z is off, z from missing values, infinite z; all 0 if it holds."""
    g = norm.groupBy(instance).agg(F.avg(z).alias("m"), F.stddev_pop(z).alias("s"), F.count(F.when(F.col(value).isNull() & F.col(z).isNotNull(), 1)).alias("ghost"), F.count(F.when(F.abs(z) == float("inf"), 1)).alias("inf"))
    return g.agg(F.count(F.when(F.abs("m") > tolerance, 1)).alias("bad_mean"), F.count(F.when(F.abs(F.col("s") - 1) > tolerance, 1)).alias("bad_sd"), F.sum("ghost").alias("z_from_missing"), F.sum("inf").alias("infinite"))


def cohort_rules(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, n_failed, holds): every rule is reported, also those that hold."""
    g = df.agg(*(F.count(F.when(~F.coalesce(c, F.lit(False)), 1)).alias(n) for n, c in rules.items()))
    each = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("n_failed")) for n in rules))
    return g.select(F.explode(each).alias("r")).select("r.rule", "r.n_failed", (F.col("r.n_failed") == 0).alias("holds"))


def identity_audit(tables: Mapping[str, DataFrame], key: str, code: str, name: str) -> DataFrame:
    """Ids that carry more than one code or name over all tables."""
    out = None
    for label, t in tables.items():
        part = t.select(F.col(key).alias("id"), F.col(code).cast("string").alias("code"), F.col(name).cast("string").alias("name")).distinct().withColumn("source", F.lit(label))
        out = part if out is None else out.unionByName(part)
    g = out.groupBy("id").agg(F.count_distinct("code").alias("n_codes"), F.count_distinct("name").alias("n_names"), F.count_distinct("source").alias("n_sources"))
    return g.withColumn("consistent", (F.col("n_codes") <= 1) & (F.col("n_names") <= 1))


def reference_check(df: DataFrame, ref: DataFrame, keys: list[str], pos: str, lo: str, hi: str) -> DataFrame:
    """Positions outside the bounds of their reference, or without one."""
    j = df.join(ref.select(*keys, lo, hi), keys, "left")
    return j.where(F.col(lo).isNull() | (F.col(pos) < F.col(lo)) | (F.col(pos) > F.col(hi))).drop(lo, hi)


def monotone_check(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which the columns do not fall from left to right."""
    bad = F.lit(False)
    for a, b in zip(columns, columns[1:], strict=False):
        bad = bad | (F.col(a) < F.col(b))
    return df.where(bad)


def snapshot_agreement(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(column, n_different) over the full outer join on the key, nulls equal; ``present`` counts one-sided rows."""
    x = a.select(F.col(key).alias("_ka"), *(F.col(c).alias(f"_a_{c}") for c in columns))
    y = b.select(F.col(key).alias("_kb"), *(F.col(c).alias(f"_b_{c}") for c in columns))
    j = x.join(y, F.col("_ka") == F.col("_kb"), "full")
    both = F.col("_ka").isNotNull() & F.col("_kb").isNotNull()
    g = j.agg(F.count(F.when(~both, 1)).alias("present"), *(F.count(F.when(both & ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), 1)).alias(c) for c in columns))
    return g.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n_different")) for c in ("present", *columns)))).alias("r")).select("r.*")
