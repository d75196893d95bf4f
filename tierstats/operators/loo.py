"""Leave-one-out without folds: what a test's statistic becomes without one value follows from ranks and counts.

No test is run again and no value is copied into folds, so the work is that of ranking: n log n rows a test, by range
partitions where a test is large (``ordered``). Equal values have equal folds, so folds are worked by distinct value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierstats.functions.exact import chi2_tail, mann_whitney_p, wilcoxon_p
from tierstats.sources.shared import staged

from .ordered import PLAIN_ROWS, Ordered, at_rank
from .stats import tail
from .windows import avg_rank


def _mw(n1, n2, u, ties):
    return mann_whitney_p(int(n1), int(n2), u, ties)


def _wx(n, w, ties, zeros):
    return wilcoxon_p(int(n), w, ties, int(zeros))


def _chi(h, df):
    return chi2_tail(h, int(df))


def _keyed(df: DataFrame, keys: list[str], other: DataFrame, how: str = "inner") -> DataFrame:
    """``df`` joined with a table of ``keys`` and more columns, whose keys are dropped; null keys match. Sort-merge, as either
    side may have hot keys."""
    right = other.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(c for c in other.columns if c not in keys))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(right.hint("merge"), on, how).drop(*(f"_k{i}" for i in range(len(keys))))


def _lost_ties(t: Column) -> Column:
    """What the sum of t^3 - t loses with one of t equal values."""
    t = t.cast("double")
    return 3 * t * t - 3 * t


def _middle(ranked: DataFrame, keys: list[str], v: str, rank: str, ties: str, n: str) -> DataFrame:
    """(keys, _a, _b, _c, _m): the values at the ranks n // 2, + 1, + 2 of each group, and its median, from average ranks."""
    first, last, m = F.col(rank) - (F.col(ties) - 1) / 2, F.col(rank) + (F.col(ties) - 1) / 2, F.floor(F.col(n) / 2)
    at = lambda k: F.max(F.when((first <= m + k) & (m + k <= last), F.col(v)))
    median = F.when(F.max(n) % 2 == 0, (at(0) + at(1)) / 2).otherwise(at(1))
    return ranked.groupBy(*keys).agg(at(0).alias("_a"), at(1).alias("_b"), at(2).alias("_c"), median.alias("_m"))


def _median_without(rank: str, ties: str, n: str) -> Column:
    """The median that is left without a value of this rank, from _a, _b, _c."""
    i, m, (a, b, c) = F.col(rank) - (F.col(ties) - 1) / 2, F.floor(F.col(n) / 2), (F.col(x) for x in ("_a", "_b", "_c"))
    odd = F.when(i <= m, b + c).when(i == m + 1, a + c).otherwise(a + b) / 2
    return F.when(F.col(n) % 2 == 0, F.when(i <= m, b).otherwise(a)).otherwise(odd)


def loo_median(df: DataFrame, test: list[str], key: list[str], v: str, plain_rows: int = PLAIN_ROWS) -> DataFrame:
    """Medians with one value left out: least, largest, range, largest shift, and whether one value dominates (tests of three
    values or more).

    Only three order statistics around the middle matter, so no value is left out in fact."""
    o = Ordered(df.where(F.col(v).isNotNull()).select(*test, *(k for k in key if k not in test), F.col(v).alias("_v")), test, ["_v", *key], plain_rows)
    r = o.total(o.running_sum(o.rows, F.lit(1), "_r"), F.lit(1), "_n")
    m = F.floor(F.col("_n") / 2)
    at = lambda k: F.max(F.when(F.col("_r") == k, F.col("_v")))
    quantile = lambda q: at_rank("_v", "_r", "_n", q)
    g = r.groupBy(*test).agg(
        F.max("_n").alias("n"), quantile(0.5).alias("median"), (quantile(0.75) - quantile(0.25)).alias("_iqr"), at(m).alias("_a"), at(m + 1).alias("_b"), at(m + 2).alias("_c"),
    ).where("n >= 3")
    even = F.col("n") % 2 == 0
    lo = F.when(even, F.col("_a")).otherwise((F.col("_a") + F.col("_b")) / 2)
    hi = F.when(even, F.col("_b")).otherwise((F.col("_b") + F.col("_c")) / 2)
    g = g.withColumns({"loo_min": lo, "loo_max": hi}).withColumn("loo_range", F.col("loo_max") - F.col("loo_min"))
    middle = F.when(even, F.col("median")).otherwise((F.col("_a") + F.col("_c")) / 2)
    g = g.withColumn("max_shift", F.greatest(F.abs(F.col("loo_min") - F.col("median")), F.abs(F.col("loo_max") - F.col("median")), F.abs(middle - F.col("median"))))
    return g.withColumn("dominated", F.col("max_shift") > F.greatest(0.5 * F.col("_iqr"), F.lit(0.25))).drop("_a", "_b", "_c", "_iqr")


def loo_tests(df: DataFrame, test: list[str], state: str, v: str, first: str = "HOLO", second: str = "APO", least: int = 3, alpha: float = 0.05, plain_rows: int = PLAIN_ROWS) -> DataFrame:
    """Leave-one-out re-runs of each Mann-Whitney test with ``least`` values on both sides, without one value of either
    side at a time (two must be left): shares below alpha and of the same sign of the difference of medians, its range.

    df has one row for each test and value that may be left out. How many values of the other state lie below a value is its
    rank in the test less its rank in its state, and with that U, the counts and the ties without the row follow from
    those of the whole test, as the medians do from three order statistics.
    """
    two = df.where(F.col(state).isin(first, second) & F.col(v).isNotNull()).select(*test, state, v)
    own = [*test, state]
    r = avg_rank(avg_rank(two, test, v, "_r", plain_rows), own, v, "_o", plain_rows)
    # equal values of a state have one fold
    one, below = F.col(state) == first, F.col("_r") - F.col("_o")
    r = staged(r.groupBy(*own, v, "_r", "_r_ties", "_o", "_o_ties").agg(F.count(F.lit(1)).alias("_cnt")), "loo-ranks")
    sizes = r.groupBy(*own).agg(F.sum("_cnt").alias("_n"))
    r = staged(_keyed(r, own, sizes), "loo-ranks")
    middle = _middle(r, own, v, "_o", "_o_ties", "_n")
    whole = r.groupBy(*test).agg(
        F.coalesce(F.sum(F.when(one, F.col("_cnt"))), F.lit(0)).alias("_n1"), F.coalesce(F.sum(F.when(~one, F.col("_cnt"))), F.lit(0)).alias("_n2"),
        F.sum(F.when(one, below * F.col("_cnt"))).alias("_u"), F.sum((F.col("_r_ties") * F.col("_r_ties") - 1).cast("double") * F.col("_cnt")).alias("_t"),
    ).where(F.least("_n1", "_n2") >= least)
    medians = middle.groupBy(*test).agg(F.max(F.when(one, F.col("_m"))).alias("_m1"), F.max(F.when(~one, F.col("_m"))).alias("_m2"))
    j = _keyed(_keyed(_keyed(r, own, middle.drop("_m")), test, whole), test, medians)
    gone, median = one.cast("int"), _median_without("_o", "_o_ties", "_n")
    j = j.withColumns({
        "n1": F.col("_n1") - gone, "n2": F.col("_n2") - 1 + gone, "u": F.col("_u") - F.when(one, below).otherwise(F.col("_n1") - below), "ties": F.col("_t") - _lost_ties(F.col("_r_ties")),
    }).where(F.least("n1", "n2") >= 2)
    j = j.withColumns({"p": tail(_mw, "n1", "n2", "u", "ties"), "delta": F.when(one, median - F.col("_m2")).otherwise(F.col("_m1") - median), "_full": F.col("_m1") - F.col("_m2")})
    c = F.col("_cnt")
    out = j.groupBy(*test).agg(
        F.sum(c).alias("n_folds"), (F.sum(c * (F.col("p") < alpha).cast("int")) / F.sum(c)).alias("share_significant"),
        (F.sum(c * (F.signum("delta") == F.signum("_full")).cast("int")) / F.sum(c)).alias("share_same_sign"), F.min("delta").alias("min_delta"), F.max("delta").alias("max_delta"),
    )
    return out.withColumn("flips", F.col("share_same_sign") < 1)


def _h(n: Column, q: Column, ties: Column) -> Column:
    """H with tie correction from the number of values, the sum of squared rank sums over sizes, and the sum of t^3 - t."""
    n = n.cast("double")  # its cube may pass a long
    return (12 / (n * (n + 1)) * q - 3 * (n + 1)) / F.when(ties < n * n * n - n, 1 - ties / (n * n * n - n))


def loo_kruskal(df: DataFrame, test: list[str], group: str, v: str, least: int = 3, alpha: float = 0.05, plain_rows: int = PLAIN_ROWS) -> DataFrame:
    """Leave-one-out re-runs of each Kruskal-Wallis test over the groups of ``least`` values or more: (test, n_folds, p_full, p_min,
    p_max, share_significant, depends). A fold's group that falls below ``least`` leaves with all its values; a fold
    with fewer than two groups has no p and is not significant. ``depends``: not all folds are significant.

    Without a value x of group g, each rank sum R_h loses A_h(x), the values of h above x and half of those equal to it, R_g also
    the rank of x. Without all of g, R_h loses the sum of A_h over g. So all folds follow from the running counts of each
    group along the distinct values: groups x distinct values rows a test.
    """
    ok = df.where(F.col(v).isNotNull() & F.col(group).isNotNull()).select(*test, F.col(group).alias("_g"), F.col(v).cast("double").alias("_v"))
    cells = staged(ok.groupBy(*test, "_g", "_v").agg(F.count(F.lit(1)).alias("_c")), "loo-cells")
    big = cells.groupBy(*test, "_g").agg(F.sum("_c").alias("_ng")).where(F.col("_ng") >= least)
    cells = staged(_keyed(cells, [*test, "_g"], big), "loo-cells")
    values = cells.groupBy(*test, "_v").agg(F.sum("_c").alias("_t"))
    o = Ordered(values, test, ["_v"], plain_rows)
    values = o.running_sum(o.rows, F.col("_t"), "_upto").drop("_part").withColumn("_r", F.col("_upto") - F.col("_t") + (F.col("_t") + 1) / 2).drop("_upto")
    values = staged(values, "loo-values")
    # every value of a test with every group of it, and the group's values up to there
    each = _keyed(values, test, big.select(*test, F.col("_g").alias("_h"), F.col("_ng").alias("_nh")))
    each = _keyed(each, [*test, "_v", "_h"], cells.select(*test, "_v", F.col("_g").alias("_h"), F.col("_c").alias("_ch")), "left").fillna(0, ["_ch"])
    o = Ordered(each, [*test, "_h"], ["_v"], plain_rows)
    each = o.running_sum(o.rows, F.col("_ch"), "_upto").drop("_part").withColumn("_above", F.col("_nh") - F.col("_upto") + F.col("_ch") / 2).drop("_upto")
    sums = _keyed(cells, [*test, "_v"], values).groupBy(*test, "_g").agg(F.sum(F.col("_c") * F.col("_r")).alias("_R"))
    each = staged(_keyed(each, [*test, "_h"], sums.withColumnRenamed("_g", "_h").withColumnRenamed("_R", "_Rh")), "loo-each")
    t = F.col("_t").cast("double")
    whole = _keyed(values.groupBy(*test).agg(F.sum("_t").alias("_n"), F.sum(t * t * t - t).alias("_ties")), test, _keyed(big, [*test, "_g"], sums).groupBy(*test).agg(F.count(F.lit(1)).alias("_k"), F.sum(F.col("_R") * F.col("_R") / F.col("_ng")).alias("_q")))
    whole = staged(whole.where("_k >= 2"), "loo-whole")
    less = F.col("_Rh") - F.col("_above")
    by_value = each.groupBy(*test, "_v").agg(F.sum(less * less / F.col("_nh")).alias("_qv"))
    own = each.where("_ch > 0").select(*test, "_v", F.col("_h").alias("_g"), "_ch", "_nh", "_above", "_Rh", "_t", "_r")
    # folds whose group stays
    stay = _keyed(_keyed(own.where(F.col("_nh") > least), [*test, "_v"], by_value), test, whole)
    mine = F.col("_Rh") - F.col("_r") - F.col("_above") + 0.5
    q = F.col("_qv") - less * less / F.col("_nh") + mine * mine / (F.col("_nh") - 1)
    stay = stay.select(*test, F.col("_ch").alias("_c"), F.col("_k").alias("k"), _h(F.col("_n") - 1, q, F.col("_ties") - _lost_ties(F.col("_t"))).alias("h"))
    # folds whose group goes: one for each of its values, all alike
    small = own.where(F.col("_nh") == least).select(*test, "_g", "_v", F.col("_ch").alias("_cg"), "_t")
    left = F.col("_t").cast("double") - F.col("_cg")
    ties = small.groupBy(*test, "_g").agg(F.sum(t * t * t - t - (left * left * left - left)).alias("_lost"))
    pairs = _keyed(each.select(*test, "_v", "_h", "_nh", "_above", "_Rh"), [*test, "_v"], small.drop("_t")).where("_h <> _g")
    pairs = pairs.groupBy(*test, "_g", "_h").agg(F.max("_nh").alias("_nh"), F.max("_Rh").alias("_Rh"), F.sum(F.col("_cg") * F.col("_above")).alias("_u"))
    rest = F.col("_Rh") - F.col("_u")
    gone = _keyed(_keyed(pairs.groupBy(*test, "_g").agg(F.sum(rest * rest / F.col("_nh")).alias("_qg")), [*test, "_g"], ties), test, whole)
    gone = gone.select(*test, F.lit(least).cast("long").alias("_c"), (F.col("_k") - 1).alias("k"), F.when(F.col("_k") > 2, _h(F.col("_n") - least, F.col("_qg"), F.col("_ties") - F.col("_lost"))).alias("h"))
    folds = stay.unionByName(gone).withColumn("p", tail(_chi, "h", F.col("k") - 1))
    c = F.col("_c")
    share = F.coalesce(F.sum(F.when(F.col("p") < alpha, c)), F.lit(0)) / F.sum(c)
    out = folds.groupBy(*test).agg(F.sum(c).alias("n_folds"), F.min("p").alias("p_min"), F.max("p").alias("p_max"), share.alias("share_significant"))
    full = whole.withColumn("_hh", _h(F.col("_n"), F.col("_q"), F.col("_ties"))).withColumn("p_full", tail(_chi, "_hh", F.col("_k") - 1)).select(*test, "p_full")
    return _keyed(out, test, full).withColumn("depends", F.col("share_significant") < 1).select(*test, "n_folds", "p_full", "p_min", "p_max", "share_significant", "depends")


def loo_signed_rank(df: DataFrame, test: list[str], d: str, left: int = 3, alpha: float = 0.05, plain_rows: int = PLAIN_ROWS) -> DataFrame:
    """Leave-one-out re-runs of each signed-rank test of the differences ``d``: (test, n_pairs, p_full, n_folds, share_significant,
    share_same_sign, flips). A fold needs ``left`` differences, not all zero; share_same_sign counts folds whose median has the
    sign of the whole one; ``flips``: some fold is on the other side of alpha than the whole test.

    Without a difference of size a, the positive rank sum loses the positive differences above a, half of those equal to it, and
    its own rank if it is positive itself; without a zero nothing but the number of zeros changes.
    """
    ok = df.where(F.col(d).isNotNull()).select(*test, F.col(d).cast("double").alias("_d"))
    ranked = avg_rank(ok, test, "_d", "_o", plain_rows)  # ranks by d itself, for the medians
    cells = staged(ranked.groupBy(*test, "_d", "_o", "_o_ties").agg(F.count(F.lit(1)).alias("_cnt")), "loo-cells")
    c, d_ = F.col("_cnt"), F.col("_d")
    sizes = cells.groupBy(*test).agg(F.sum("_cnt").alias("n_pairs"), F.coalesce(F.sum(F.when(d_ == 0, c)), F.lit(0)).alias("_zeros"))
    cells = staged(_keyed(cells, test, sizes), "loo-cells")
    middle = _middle(cells, test, "_d", "_o", "_o_ties", "n_pairs")
    size = cells.where("_d <> 0").groupBy(*test, F.abs("_d").alias("_a0")).agg(F.sum("_cnt").alias("_t"), F.coalesce(F.sum(F.when(d_ > 0, c)), F.lit(0)).alias("_pos"))
    o = Ordered(size, test, ["_a0"], plain_rows)
    size = o.running_sum(o.running_sum(o.rows, F.col("_t"), "_upto"), F.col("_pos"), "_pos_upto").drop("_part")
    size = staged(size.withColumn("_r", F.col("_upto") - F.col("_t") + (F.col("_t") + 1) / 2).drop("_upto"), "loo-sizes")
    t = F.col("_t").cast("double")
    whole = size.groupBy(*test).agg(F.sum("_t").alias("_n"), F.sum("_pos").alias("_p"), F.sum(F.col("_pos") * F.col("_r")).alias("_w"), F.sum(t * t * t - t).alias("_ties"))
    j = _keyed(_keyed(cells, test, whole), test, middle)
    j = _keyed(j.withColumn("_a0", F.abs("_d")), [*test, "_a0"], size, "left")
    zero, up = d_ == 0, (d_ > 0).cast("int")
    w = F.col("_w") - F.when(zero, 0.0).otherwise(up * F.col("_r") + (F.col("_p") - F.col("_pos_upto")) + (F.col("_pos") - up) / 2)
    j = j.withColumns({
        "n": F.when(zero, F.col("_n")).otherwise(F.col("_n") - 1), "w": w, "ties": F.col("_ties") - F.when(zero, 0.0).otherwise(_lost_ties(F.col("_t"))),
        "zeros": F.when(zero, F.col("_zeros") - 1).otherwise(F.col("_zeros")), "_left": _median_without("_o", "_o_ties", "n_pairs"),
    })
    j = j.where((F.col("n_pairs") - 1 >= left) & (F.col("n") > 0)).withColumns({"p": tail(_wx, "n", "w", "ties", "zeros"), "p_full": tail(_wx, "_n", "_w", "_ties", "_zeros")})
    share = lambda good: F.sum(c * F.coalesce(good.cast("int"), F.lit(0))) / F.sum(c)
    flips = F.max(((F.col("p") < alpha) != (F.col("p_full") < alpha)).cast("int")) == 1
    return j.groupBy(*test).agg(
        F.max("n_pairs").alias("n_pairs"), F.max("p_full").alias("p_full"), F.sum("_cnt").alias("n_folds"), share(F.col("p") < alpha).alias("share_significant"),
        share(F.signum("_left") == F.signum("_m")).alias("share_same_sign"), flips.alias("flips"),
    )
