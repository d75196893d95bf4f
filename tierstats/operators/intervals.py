"""Coverage by intervals: union lengths, and the sum that double counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import merge_intervals


def union_coverage(df: DataFrame, keys: list[str], b: str, e: str, total: Column) -> DataFrame:
    """Regions, length of their union and its share of ``total``."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_regions"))
    u = merge_intervals(df, keys, b, e).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start") + 1).alias("union_length"))
    return n.join(u, keys).withColumn("coverage", F.col("union_length") / total)


def short_mapping(df: DataFrame, keys: list[str], b: str, e: str, total: Column, least: float = 0.05, length: int = 30) -> DataFrame:
    return union_coverage(df, keys, b, e, total).where((F.col("coverage") < least) | (F.col("union_length") < length))


def naive_mapping(df: DataFrame, keys: list[str], b: str, e: str, total: Column) -> DataFrame:
    """Coverage by the sum of lengths, to show where regions count twice."""
    g = df.groupBy(*keys).agg(F.sum(F.col(e) - F.col(b) + 1).alias("summed")).withColumn("coverage", F.col("summed") / total)
    return g.withColumn("double_counted", F.col("coverage") > 1)
