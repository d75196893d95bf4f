"""Ranking, gaps and islands, intervals, false-discovery control. Every ranking ends in a unique key.

Windows are partitioned by a key of bounded size (an instance, a unit); ranks and false-discovery control, whose families and
tests may hold all rows, go by ``ordered``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tierstats.sources.shared import staged

from .ordered import PLAIN_ROWS, Ordered

ONE = F.lit


def _first(df: DataFrame, keys: list[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def select_representative(df: DataFrame, keys: list[str], cascade: Sequence[tuple[str, bool]]) -> DataFrame:
    """The best row of each key by a cascade of (column, descending), and ``decided_by``: the first column that
    narrowed the field, FULL_TIE if all columns tie."""
    order = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in cascade]
    best = _first(df, keys, order).drop("rank")
    n = df.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.count(ONE(1)).alias("_n"))
    j = best.join(n, [F.col(k) == F.col(f"_{k}") for k in keys]).drop(*(f"_{k}" for k in keys))
    b = best.select(*(F.col(k).alias(f"_{k}") for k in keys), *(F.col(c).alias(f"_b_{c}") for c, _ in cascade))
    all_rows = df.join(b, [F.col(k) == F.col(f"_{k}") for k in keys])
    ties, same = [], ONE(True)
    for c, _ in cascade:
        same = same & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
        ties.append(F.count(F.when(same, 1)).alias(f"_t_{c}"))
    t = all_rows.groupBy(*(F.col(f"_{k}") for k in keys)).agg(*ties)
    j = j.join(t, [F.col(k) == F.col(f"_{k}") for k in keys]).drop(*(f"_{k}" for k in keys))
    decided = F.when(F.col("_n") == 1, "ONLY_ONE")
    for c, _ in cascade:
        decided = decided.when(F.col(f"_t_{c}") < F.col("_n"), c)
    return j.withColumn("decided_by", decided.otherwise("FULL_TIE")).withColumnRenamed("_n", "n_candidates").drop(*(f"_t_{c}" for c, _ in cascade))


def select_reference(df: DataFrame, unit: str, pools: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """Best row of each unit: within the first pool that is not empty, then the second, then by ``order``."""
    return _first(df, [unit], [F.coalesce(p, ONE(False)).desc() for p in pools] + list(order)).drop("rank")


def top_n(df: DataFrame, keys: list[str], order: Sequence[Column], n: int) -> DataFrame:
    return _first(df, keys, order, n)


def runs(df: DataFrame, keys: list[str], pos: str, state: str) -> DataFrame:
    """Maximal runs of one state over consecutive positions: (keys, state, start, end, length)."""
    d = df.select(*keys, pos, state).distinct()
    island = F.col(pos) - F.row_number().over(W.partitionBy(*keys, state).orderBy(pos))
    g = d.withColumn("_i", island).groupBy(*keys, state, "_i").agg(F.min(pos).alias("start"), F.max(pos).alias("end"))
    return g.drop("_i").withColumn("length", F.col("end") - F.col("start") + 1)


def merge_gaps(run: DataFrame, keys: list[str], state: str, joined: str, gap: int = 5) -> DataFrame:
    """Runs of state ``joined`` with at most ``gap`` positions between them become one, never across another state."""
    w = W.partitionBy(*keys).orderBy("start")
    prev_state, prev_end = F.lag(state).over(w), F.lag("end").over(w)
    goes_on = (F.col(state) == joined) & (prev_state == joined) & (F.col("start") - prev_end - 1 <= gap)
    r = run.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_g", F.sum("_new").over(w))
    g = r.groupBy(*keys, "_g").agg(F.min(state).alias(state), F.min("start").alias("start"), F.max("end").alias("end"), F.count(ONE(1)).alias("n_merged"))
    return g.drop("_g")


def merge_intervals(df: DataFrame, keys: list[str], b: str, e: str, plain_rows: int = PLAIN_ROWS) -> DataFrame:
    """Union of overlapping or adjacent inclusive intervals. One key may have all of them: beyond ``plain_rows`` distinct
    intervals they are swept in range partitions, whose reach is carried over to the next ones."""
    o = Ordered(df.select(*keys, b, e).distinct(), keys, [b, e], plain_rows)
    d = o.preceding_max(o.rows, e, "_reach")
    d = o.settled(d.withColumn("_new", F.when(F.col(b) <= F.col("_reach") + 1, 0).otherwise(1)))
    d = o.running_sum(d, F.col("_new"), "_g")
    return d.groupBy(*keys, "_g").agg(F.min(b).alias("start"), F.max(e).alias("end")).drop("_g")


def missing_runs(grid: DataFrame, keys: list[str], pos: str, missing: Column) -> DataFrame:
    """Runs of missing positions on a dense grid by kind: terminal if they touch an end, else internal."""
    ends = grid.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.min(pos).alias("_lo"), F.max(pos).alias("_hi"))
    r = runs(grid.withColumn("_m", missing).where("_m"), keys, pos, "_m").join(ends.hint("merge"), [F.col(k) == F.col(f"_{k}") for k in keys])
    r = r.withColumn("terminal", (F.col("start") == F.col("_lo")) | (F.col("end") == F.col("_hi")))
    inner, outer = F.when(~F.col("terminal"), F.col("length")), F.when(F.col("terminal"), F.col("length"))
    return r.groupBy(*keys).agg(F.count(inner).alias("n_internal"), F.coalesce(F.sum(inner), ONE(0)).alias("len_internal"), F.count(outer).alias("n_terminal"), F.coalesce(F.sum(outer), ONE(0)).alias("len_terminal"), F.max("length").alias("longest"))


def terminal_gaps(grid: DataFrame, keys: list[str], pos: str, observed: Column) -> DataFrame:
    """Positions before the first and after the last observed one; null if nothing is observed."""
    seen = F.when(observed, F.col(pos))
    g = grid.groupBy(*keys).agg(F.min(pos).alias("_lo"), F.max(pos).alias("_hi"), F.min(seen).alias("_a"), F.max(seen).alias("_b"), F.count(seen).alias("n_observed"))
    return g.select(*keys, (F.col("_a") - F.col("_lo")).alias("leading"), (F.col("_hi") - F.col("_b")).alias("trailing"), (F.col("_b") - F.col("_a") + 1 - F.col("n_observed")).alias("interior_missing"))


def bh_fdr(df: DataFrame, p: str, family: list[str], key: list[str], out: str = "q", plain_rows: int = PLAIN_ROWS) -> DataFrame:
    """Benjamini-Hochberg q within each family; null p stay out of the family and of its size.

    key: a unique key of the rows, the last part of the order. A family may hold all rows of a large table: beyond
    ``plain_rows`` rows, ranks are prefix sums and minima are suffix minima over range partitions."""
    o = Ordered(df.withColumn("_null", F.col(p).isNull()), [*family, "_null"], [p, *key], plain_rows)
    d = o.total(o.running_sum(o.rows, ONE(1), "_k"), ONE(1), "_m")
    d = o.following_min(o.settled(d.withColumn("_r", F.col(p) * F.col("_m") / F.col("_k"))), "_r", "_q")
    return d.withColumn(out, F.when(~F.col("_null"), F.least(ONE(1.0), "_q"))).drop("_null", "_k", "_m", "_r", "_q", "_part")


def fdr_audit(df: DataFrame, p: str, stored: str, family: list[str], key: list[str], tolerance: float = 1e-9, plain_rows: int = PLAIN_ROWS) -> DataFrame:
    """q computed again, family size, rank in the family and overall, and whether the stored q agrees. Families may be large,
    as in ``bh_fdr``."""
    own = Ordered(bh_fdr(df, p, family, key, "q_again", plain_rows), family, [p, *key], plain_rows)
    d = own.total(own.running_sum(own.rows, ONE(1), "family_rank"), F.col(p).isNotNull().cast("long"), "family_size").drop("_part")
    every = Ordered(d, [], [p, *family, *key], plain_rows)
    d = every.running_sum(every.rows, ONE(1), "global_rank").drop("_part")
    return d.withColumn("agrees", F.abs(F.col(stored) - F.col("q_again")) <= tolerance)


def rank_min_desc(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.withColumn("rank", F.rank().over(W.partitionBy(*keys).orderBy(F.desc(value))))


def top_bottom_share(df: DataFrame, keys: list[str], value: str, key: str, share: float = 0.1, least: int = 10) -> DataFrame:
    """Flags the top and bottom max(1, round(share x n)) rows of groups of ``least`` rows; halves round to even."""
    w = W.partitionBy(*keys)
    n = F.count(ONE(1)).over(w)
    k = F.greatest(ONE(1), F.bround(share * n))
    d = df.withColumn("_n", n).withColumn("_k", k).withColumn("_d", F.row_number().over(w.orderBy(F.desc(value), key))).withColumn("_a", F.row_number().over(w.orderBy(value, key)))
    big = F.col("_n") >= least
    return d.withColumns({"is_top": big & (F.col("_d") <= F.col("_k")), "is_bottom": big & (F.col("_a") <= F.col("_k"))}).drop("_n", "_k", "_d", "_a")


def avg_rank(df: DataFrame, test: list[str], v: str, out: str = "r", plain_rows: int = PLAIN_ROWS) -> DataFrame:
    """Average ranks with ties within each test, and ``out``_ties, the number of rows that share the value. Distinct values are
    ranked with their counts, so ties do not count; a test of more than ``plain_rows`` distinct values is ranked by
    prefix sums over range partitions."""
    df = staged(df, "ranked")  # counted and ranked from one and the same table, which may come from a generator
    counts = df.groupBy(*(F.col(t).alias(f"_{t}") for t in test), F.col(v).alias("_v")).agg(F.count(ONE(1)).alias("_n"))
    keys = [f"_{t}" for t in test]
    if df.count() <= plain_rows:
        upto = F.sum("_n").over(W.partitionBy(*keys).orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow))
        counts = counts.withColumn(out, upto)
    else:
        o = Ordered(counts, keys, ["_v"], plain_rows)
        counts = o.running_sum(o.rows, F.col("_n"), out).drop("_part")
    counts = counts.withColumn(out, F.col(out) - F.col("_n") + (F.col("_n") + 1) / 2).withColumnRenamed("_n", f"{out}_ties")
    return df.join(counts.hint("merge"), [F.col(t) == F.col(f"_{t}") for t in test] + [F.col(v) == F.col("_v")]).drop(*keys, "_v")


def duplicate_flag(df: DataFrame, keys: list[str]) -> DataFrame:
    """Marks every member of a group of more than one row."""
    n = df.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.count(ONE(1)).alias("_n"))
    return df.join(n, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).withColumn("is_duplicate", F.col("_n") > 1).drop(*(f"_{k}" for k in keys), "_n")


def fractional_position(df: DataFrame, keys: list[str], rank: Column, pos: str) -> DataFrame:
    """rank x 100 + 100 x i / (n - 1) for the i-th of n positions; 0 for a single one."""
    w = W.partitionBy(*keys)
    i, n = F.row_number().over(w.orderBy(pos)) - 1, F.count(ONE(1)).over(w)
    return df.withColumn("fraction", rank * 100 + F.when(n > 1, 100 * i / (n - 1)).otherwise(0.0))


def components_for(variances: DataFrame, keys: list[str], component: str, variance: str, targets: Sequence[float]) -> DataFrame:
    """First component at which the cumulative share of the variance reaches each target."""
    w = W.partitionBy(*keys)
    c = variances.withColumn("cum", F.sum(variance).over(w.orderBy(component).rowsBetween(W.unboundedPreceding, W.currentRow)) / F.sum(variance).over(w))
    return c.groupBy(*keys).agg(*(F.min(F.when(F.col("cum") >= t - 1e-12, F.col(component))).alias(f"n_{round(t * 100)}") for t in targets))


def dedupe_ranked(df: DataFrame, keys: list[str], confidence: str, levels: Sequence[str], then: Sequence[str]) -> DataFrame:
    """One row a key: best confidence in the order of ``levels``, then ``then``."""
    return _first(df, keys, [F.array_position(F.array(*(ONE(x) for x in levels)), F.col(confidence)), *(F.col(c) for c in then)]).drop("rank")


def first_by_time(df: DataFrame, key: str, t: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(F.struct(F.col(t).alias("t"), F.col(value).alias("v")))["v"].alias(f"first_{value}"))


def union_tables(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def partition_units(units: DataFrame, unit: str, with_candidate: DataFrame, zero: DataFrame) -> DataFrame:
    """Each unit in exactly one of WITH_CANDIDATE, ZERO_RESULT and REST."""
    a, z = with_candidate.select(F.col(unit).alias("_a")).distinct(), zero.select(F.col(unit).alias("_z")).distinct()
    j = units.select(unit).distinct().join(a, F.col(unit) == F.col("_a"), "left").join(z, F.col(unit) == F.col("_z"), "left")
    return j.select(unit, F.when(F.col("_a").isNotNull(), "WITH_CANDIDATE").when(F.col("_z").isNotNull(), "ZERO_RESULT").otherwise("REST").alias("part"))


def membership_lists(df: DataFrame, level: str, status: str, unit: str, statuses: Sequence[str]) -> DataFrame:
    return df.groupBy(level).agg(*(F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col(status) == s, F.col(unit))))).alias(s.lower()) for s in statuses))
