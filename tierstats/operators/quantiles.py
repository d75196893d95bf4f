"""Quantiles of groups of any size: exact by histogram refinement, or from mergeable sketches.

``percentile`` and ``median`` keep a group's values in one buffer. Here only groups of a bounded size go that way; a larger
one is counted in bins between its least and largest value, and only the bin that holds a wanted rank is counted again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tierstats.sources.shared import discard, staged

#: Up to so many values a group is one buffer; bins of a round.
PLAIN_VALUES, BINS = 1_000_000, 4096
#: Up to so many bounds or groups a table is sent to the tasks.
MOST_SENT = 100_000


def _bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Monotone in v, also where the bounds are infinite or NaN, which is the largest value."""
    inner = F.nanvl(F.floor((v - lo) / (hi - lo) * bins).cast("double"), F.lit(bins / 2))
    return F.when(v == lo, 0).when(v == hi, bins - 1).otherwise(F.least(F.greatest(inner, F.lit(0.0)), F.lit(bins - 1.0))).cast("int")


def _sized(rows: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """A written table with a hint for its join: sent to the tasks if it has few rows, else merged."""
    return F.broadcast(rows) if rows.count() <= most else rows.hint("merge")


def selected(values: DataFrame, targets: DataFrame, keys: list[str], v: str, plain_values: int = PLAIN_VALUES, bins: int = BINS, most_sent: int = MOST_SENT) -> DataFrame:
    """(keys, rank, value): the values of the given ranks, from 0, of large groups. values: (keys, v) without nulls, stored; targets:
    (keys, rank), a row for each wanted rank of a group with many values.

    A round counts the values between two bounds by bin, once for all ranks that lie there; ranks whose bin has one value are
    found, those whose bin has at most ``plain_values`` values are found among its distinct values, the others go on inside
    their bin. Up to ``most_sent`` pairs of bounds are sent to the tasks; more are joined by key.
    """
    spark = values.sparkSession
    own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    ends = values.groupBy(*own).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    both = F.lit(True)
    for n, k in zip(names, keys, strict=True):
        both = both & F.col(n).eqNullSafe(F.col(f"t_{k}"))
    wanted = staged(targets.groupBy(*(F.col(k).alias(f"t_{k}") for k in keys)).agg(F.collect_set("rank").alias("_ranks")), "quantile-wanted")
    todo = staged(ends.join(_sized(wanted, most_sent), both).select(*names, "_ranks", "_lo", "_hi", F.lit(0).cast("long").alias("_before")), "quantile-todo")
    found, value = None, F.col(v)
    here = F.filter("_ranks", lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_n")))
    while not todo.isEmpty():
        inside = values.select(*keys, v).join(_sized(todo, most_sent), same & (value >= F.col("_lo")) & (value <= F.col("_hi")))
        hist = inside.groupBy(*names, "_before", "_ranks", _bin(value, F.col("_lo"), F.col("_hi"), bins).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
        upto = F.sum("_n").over(W.partitionBy(*names, "_before").orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow))
        hist = hist.withColumn("_upto", F.col("_before") + upto).withColumn("_ranks", here).where(F.size("_ranks") > 0)
        hist = staged(hist.select(*names, "_ranks", "_lo", "_hi", (F.col("_upto") - F.col("_n")).alias("_before"), "_n"), "quantile-bins")
        one = hist.where("_lo = _hi").select(*names, F.explode("_ranks").alias("rank"), F.col("_lo").alias("value"))
        few = staged(hist.where(f"_lo <> _hi AND _n <= {plain_values}").drop("_n"), "quantile-few")
        if not few.isEmpty():
            left = values.select(*keys, v).join(_sized(few, most_sent), same & (value >= F.col("_lo")) & (value <= F.col("_hi")))
            left = left.groupBy(*names, "_before", "_ranks", value.alias("value")).agg(F.count(F.lit(1)).alias("_n"))
            upto = F.col("_before") + F.sum("_n").over(W.partitionBy(*names, "_before").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow))
            left = left.withColumn("_upto", upto).withColumn("_ranks", here).where(F.size("_ranks") > 0)
            one = one.unionByName(left.select(*names, F.explode("_ranks").alias("rank"), "value"))
        one = staged(one, "quantile-found")
        found = one if found is None else found.unionByName(one)
        rest = staged(hist.where(f"_lo <> _hi AND _n > {plain_values}").drop("_n"), "quantile-todo")
        for done in (todo, hist, few):
            discard(spark, done)
        todo = rest
    discard(spark, wanted)
    if found is None:
        found = todo.select(*names, F.explode("_ranks").alias("rank"), F.col("_lo").alias("value"))
    return found.select(*(F.col(n).alias(k) for n, k in zip(names, keys, strict=True)), "rank", "value")


def quantiles(df: DataFrame, keys: list[str], v: str, shares: Sequence[float], plain_values: int = PLAIN_VALUES, bins: int = BINS, sketch: int | None = None) -> DataFrame:
    """(keys, n, q): for each group the number of values that are not null and an array of quantiles, between two neighbours in line.

    Exact, and equal to ``percentile``. Groups of more than ``plain_values`` values are refined by histograms (``selected``), of at
    most N / plain_values groups. sketch: instead, one pass with a mergeable KLL sketch of this size (from 8 to 65535; the rank error
    is about 1.65 / size ** 0.9) in each task and group, whatever the group's size; values then are those of the group.
    """
    if sketch is not None:
        g = df.where(F.col(v).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(v).cast("double"), sketch).alias("_s"))
        return g.select(*keys, "n", F.array(*(F.kll_sketch_get_quantile_double("_s", F.lit(float(p))) for p in shares)).alias("q"))
    values = staged(df.where(F.col(v).isNotNull()).select(*keys, F.col(v).cast("double").alias(v)), "quantile-values")
    shares_of = F.array(*(F.lit(float(p)) for p in shares))
    plain = lambda rows: rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile(v, shares_of).alias("q"))
    if values.count() <= plain_values:
        return plain(values)
    hot = staged(values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > plain_values), "quantile-hot")
    if hot.isEmpty():
        return plain(values)
    place = lambda n: F.transform(shares_of, lambda p: p * (n - 1))
    ranks = F.array_distinct(F.flatten(F.transform(place(F.col("n")), lambda x: F.array(F.floor(x), F.ceil(x)))))
    targets = staged(hot.select(*keys, F.explode(ranks).alias("rank")), "quantile-targets")
    got = selected(values, targets, keys, v, plain_values, bins).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_m"))
    on, rest = F.lit(True), F.lit(True)
    for k in keys:
        on, rest = on & F.col(k).eqNullSafe(F.col(f"_g{k}")), rest & F.col(k).eqNullSafe(F.col(f"_h{k}"))

    def between(x: Column) -> Column:
        a, b = F.element_at("_m", F.floor(x)), F.element_at("_m", F.ceil(x))
        return F.when(a == b, a).otherwise((F.ceil(x) - x) * a + (x - F.floor(x)) * b)

    got = staged(got, "quantile-got")
    large = hot.join(got.select(*(F.col(k).alias(f"_g{k}") for k in keys), "_m").hint("merge"), on).select(*keys, "n", F.transform(place(F.col("n")), between).alias("q"))
    small = values.join(_sized(hot.select(*(F.col(k).alias(f"_h{k}") for k in keys)), MOST_SENT), rest, "left_anti") if keys else values.limit(0)
    return large.unionByName(plain(small)) if keys else large
