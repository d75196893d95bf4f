"""Aggregation up the hierarchy record -> position -> instance -> entry -> unit.

Nulls stay nulls: a missing value is never zero and never drops a row. Medians and quantiles are exact with linear
interpolation; groups are instances, entries or units, never a whole table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quantiles import quantiles

N = F.count


def _count() -> Column:
    return F.count(F.lit(1))


def _when(c: Column) -> Column:
    return F.count(F.when(c, F.lit(1)))


def pick_record(df: DataFrame, keys: list[str], occupancy: str, value: str, ties: list[str]) -> DataFrame:
    """One record per ``keys``: highest positive occupancy with a value, then ``ties`` ascending. The value decides
    only if it is among the ties. If no record qualifies the value is null and the row stays."""
    ok = (F.col(occupancy) > 0) & F.col(value).isNotNull()
    rank = F.struct(F.when(ok, -F.col(occupancy)).otherwise(0.0).alias("o"), *(F.col(t) for t in ties if t != value), F.col(value).alias("_v"))
    best = F.min(F.struct(rank.alias("r"), F.when(ok, F.col(value)).alias("x")))
    return df.groupBy(*keys).agg(_count().alias("n_records"), best.alias("_b")).select(*keys, "n_records", F.col("_b.x").alias(value))


def pick_from_arrays(labels: Column, occupancies: Column, values: Column) -> Column:
    """The chosen record (label, occ, val) of parallel arrays: occupancy above 0 and a value; highest occupancy, then
    blank label, then "A", then by label. Null if none qualifies."""
    z = F.arrays_zip(labels.alias("label"), occupancies.alias("occ"), values.alias("val"))
    ok = F.filter(z, lambda r: (r["occ"] > 0) & r["val"].isNotNull() & ~F.isnan(r["val"]))
    order = F.array_sort(F.transform(ok, lambda r: F.struct((-r["occ"]).alias("o"), F.when(r["label"] == "", 0).when(r["label"] == "A", 1).otherwise(2).alias("p"), r["label"].alias("label"), r["occ"].alias("occ"), r["val"].alias("val"))))
    return F.get(order, F.lit(0))


def observation_flags(occupancies: Column, values: Column) -> dict[str, Column]:
    z = F.arrays_zip(occupancies.alias("o"), values.alias("v"))
    positive = F.size(F.filter(occupancies, lambda o: o > 0))
    return {
        "record_present": F.coalesce(F.size(occupancies) > 0, F.lit(False)),
        "any_positive": F.exists(occupancies, lambda o: o > 0),
        "usable": F.exists(z, lambda r: (r["o"] > 0) & r["v"].isNotNull()),
        "zero_only": (F.size(occupancies) > 0) & (positive == 0),
        "n_positive": positive,
    }


def zscore_within(df: DataFrame, instance: str, value: str, min_sd: float = 1e-12, plain_values: int | None = None) -> DataFrame:
    """Adds n_usable, mean, median, sd (population), q25, q75, iqr, z, instance_status and row_status.

    One aggregate by instance is joined back, so an instance of any size needs no window buffer. plain_values: as in ``summary``."""
    v = F.col(value)
    rest = [F.count(v).alias("n_usable"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("_sd")]
    if plain_values is None:
        s = df.groupBy(F.col(instance).alias("_i")).agg(*rest, F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    else:
        own = df.select(F.col(instance).alias("_i"), value)
        s = _with_quantiles(own.groupBy("_i").agg(*rest), own, ["_i"], value, plain_values)
    two = F.col("n_usable") >= 2
    s = s.withColumns({"sd": F.when(two, F.col("_sd")), "q25": F.col("_q")[0], "median": F.col("_q")[1], "q75": F.col("_q")[2]})
    s = s.withColumn("iqr", F.when(two, F.col("q75") - F.col("q25")))
    s = s.withColumn("instance_status", F.when(~two, "NOT_NORMALIZABLE_FEW_VALUES").when(F.col("sd") <= min_sd, "NOT_NORMALIZABLE_CONSTANT").otherwise("NORMALIZED")).drop("_sd", "_q")
    out = df.join(s, F.col(instance) == F.col("_i")).drop("_i")
    good = F.col("instance_status") == "NORMALIZED"
    return out.withColumns({"z": F.when(good, (v - F.col("mean")) / F.col("sd")), "row_status": F.when(v.isNull(), "VALUE_MISSING").when(~good, F.col("instance_status")).otherwise("NORMALIZED")})


def zscores(df: DataFrame, keys: list[str], value: str, min_sd: float = 1e-12) -> DataFrame:
    """``df`` with z as in ``zscore_within``, for instances of few rows: by a window over ``keys``, so that rows which lie together
    by some of the keys are not dealt out again."""
    v, w = F.col(value), W.partitionBy(*keys)
    d = df.withColumns({"_n": F.count(v).over(w), "_m": F.avg(v).over(w), "_s": F.stddev_pop(v).over(w)})
    return d.withColumn("z", F.when((F.col("_n") >= 2) & (F.col("_s") > min_sd), (v - F.col("_m")) / F.col("_s"))).drop("_n", "_m", "_s")


def instance_summary(df: DataFrame, instance: str, value: str, z: str, band: float = 1.5) -> DataFrame:
    zc = F.col(z)
    return df.groupBy(instance).agg(
        _count().alias("n_rows"), F.count(value).alias("n_usable"), (F.count(value) / _count()).alias("usable_fraction"), F.avg(value).alias("mean"), F.median(value).alias("median"),
        F.min(zc).alias("min_z"), F.max(zc).alias("max_z"), F.avg(F.when(zc.isNotNull(), (zc > band).cast("int"))).alias("share_above"), F.avg(F.when(zc.isNotNull(), (zc < -band).cast("int"))).alias("share_below"),
    )


def add_columns(master: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns mapped in by id; rows and old columns of ``master`` are unchanged (an earlier version is replaced)."""
    r = right.select(F.col(key).alias("_k"), *columns)
    return master.drop(*columns).join(r, F.col(key) == F.col("_k"), "left").drop("_k")


def entry_attributes(df: DataFrame, keys: list[str], state: str, number: str, flag: Column) -> DataFrame:
    """Shared state, or AMBIGUOUS with a conflict flag; a conflicting ``number`` is an error."""
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_set(state)).alias("states"), F.max(number).alias(number), F.min(number).alias("_lo"), F.bool_or(flag).alias("any_member"))
    g = g.withColumn("conflict", F.size("states") > 1).withColumn("state", F.when(F.size("states") == 1, F.col("states")[0]).otherwise("AMBIGUOUS"))
    same = F.assert_true(F.col(number).eqNullSafe(F.col("_lo")), F.lit(f"conflicting {number}"))
    return g.withColumn(number, F.when(same.isNull(), F.col(number))).drop("_lo")


def medians(df: DataFrame, keys: list[str], value: str, out: str, *rest: Column) -> DataFrame:
    """(keys, ``out``: median of ``value``, ``rest``: other aggregates) of each group, for many groups of few rows: rows are sorted
    once and the middle ones averaged, where ``F.median`` keeps and writes a map of values for each group. Null values count
    for ``rest`` only."""
    w = W.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last())
    n = F.count(value).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    ranked = df.withColumns({"_r": 2 * F.row_number().over(w), "_m": n})
    middle = F.avg(F.when(F.col("_r").between(F.col("_m"), F.col("_m") + 2), F.col(value)))  # one row of an odd number, else two
    return ranked.groupBy(*keys).agg(middle.alias(out), *rest)


def entry_position_profile(norm: DataFrame, keys: list[str]) -> DataFrame:
    """Median z of the normalisable instances at each entry and position."""
    return medians(norm.where(F.col("z").isNotNull()), keys, "z", "z", _count().alias("n_instances"))


def _with_quantiles(g: DataFrame, df: DataFrame, keys: list[str], value: str, plain_values: int) -> DataFrame:
    """``g`` (one row a key) with _q, the quartiles, of groups of any size."""
    q = quantiles(df, keys, value, (0.25, 0.5, 0.75), plain_values).select(*(F.col(k).alias(f"_q_{k}") for k in keys), F.col("q").alias("_q"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_q_{k}"))
    return g.join(q.hint("merge"), on, "left").drop(*(f"_q_{k}" for k in keys))


def summary(df: DataFrame, keys: list[str], value: str, sd: str = "samp", plain_values: int | None = None) -> DataFrame:
    """n, mean, median, SD, quartiles, min and max; the sample SD of one value is null.

    plain_values: groups with more values than that get their quartiles by histogram refinement, so that no group need fit
    a buffer; None: every group is one."""
    v = F.col(value)
    rest = [F.count(v).alias("n"), F.avg(v).alias("mean"), (F.stddev_samp(v) if sd == "samp" else F.stddev_pop(v)).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max")]
    if plain_values is None:
        g = df.groupBy(*keys).agg(*rest, F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    else:
        g = _with_quantiles(df.groupBy(*keys).agg(*rest), df, keys, value, plain_values)
    return g.withColumns({"q25": F.col("_q")[0], "median": F.col("_q")[1], "q75": F.col("_q")[2]}).drop("_q")


def unit_position_profile(prof: DataFrame, keys: list[str], value: str, state: str, pair: tuple[str, str] = ("APO", "HOLO"), plain_values: int | None = None) -> DataFrame:
    """``summary`` and the medians by state; ``delta`` only if both states are there. plain_values: as there."""
    a, b = (f"median_{s.lower()}" for s in pair)
    if plain_values is None:
        by = {s: F.median(F.when(F.col(state) == s, F.col(value))).alias(f"median_{s.lower()}") for s in pair}
        states = prof.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(*by.values())
    else:
        q = quantiles(prof.where(F.col(state).isin(*pair)), [*keys, state], value, (0.5,), plain_values)
        states = q.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(*(F.max(F.when(F.col(state) == s, F.col("q")[0])).alias(f"median_{s.lower()}") for s in pair))
    out = summary(prof, keys, value, plain_values=plain_values).join(states, [F.col(k) == F.col(f"_{k}") for k in keys], "inner" if plain_values is None else "left").drop(*(f"_{k}" for k in keys))
    return out.withColumn("delta", F.col(b) - F.col(a))


def unit_summary(units: DataFrame, unit: str, prof: DataFrame, value: str, levels: Sequence[int] = (3, 5, 10)) -> DataFrame:
    """All units: status, positions by support and share of positions beyond 1."""
    pos = prof.groupBy(unit, "position").agg(_count().alias("n"), F.median(value).alias("m"))
    g = pos.groupBy(F.col(unit).alias("_u")).agg(
        _count().alias("n_positions"), *(_when(F.col("n") >= k).alias(f"n_at_{k}") for k in levels), F.avg((F.col("m") > 1).cast("int")).alias("share_high"), F.avg((F.col("m") < -1).cast("int")).alias("share_low")
    )
    out = units.join(g, F.col(unit) == F.col("_u"), "left").drop("_u").fillna(0, ["n_positions", *(f"n_at_{k}" for k in levels)])
    return out.withColumn("status", F.when(F.col("n_positions") == 0, "NO_DATA").when(F.col(f"n_at_{levels[0]}") == 0, "INSUFFICIENT").otherwise("PROFILED"))


def constants(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns that are constant in each group; a group with two values fails."""
    g = df.groupBy(*keys).agg(*(F.min(c).alias(c) for c in columns), *(F.max(c).alias(f"_{c}") for c in columns), _count().alias("n"))
    for c in columns:
        g = g.withColumn(c, F.when(F.assert_true(F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(f"{c} is not constant")).isNull(), F.col(c)))
    return g.drop(*(f"_{c}" for c in columns))


def segment_coverage(seen: DataFrame, keys: list[str], segments: DataFrame, segment: str, position: str) -> DataFrame:
    """Distinct positions seen over positions expected; ``segments`` holds one row a (segment, position)."""
    expected = segments.groupBy(segment).agg(_count().alias("n_expected"))
    j = seen.join(segments, position).groupBy(*keys, segment).agg(F.count_distinct(position).alias("n_observed"))
    return j.join(expected, segment).withColumn("coverage", F.col("n_observed") / F.col("n_expected"))


def entry_segment_features(prof: DataFrame, keys: list[str], value: str) -> DataFrame:
    return summary(prof, keys, value, sd="pop").withColumn("iqr", F.col("q75") - F.col("q25"))


def unit_segment_profile(feat: DataFrame, keys: list[str], value: str, mean: str, state: str, entries: DataFrame, unit: str) -> DataFrame:
    """Median and mean over entries, support as a share of all the unit's entries, and medians by state."""
    all_entries = entries.groupBy(F.col(unit).alias("_u")).agg(_count().alias("n_entries_all"))
    g = feat.groupBy(*keys).agg(
        _count().alias("n_entries"), F.median(value).alias("median_of_medians"), F.avg(value).alias("mean_of_medians"), F.median(mean).alias("median_of_means"), F.stddev_pop(value).alias("sd"),
        F.median(F.when(F.col(state) == "APO", F.col(value))).alias("median_apo"), F.median(F.when(F.col(state) == "HOLO", F.col(value))).alias("median_holo"),
    )
    return g.join(all_entries, F.col(unit) == F.col("_u")).drop("_u").withColumn("support", F.col("n_entries") / F.col("n_entries_all"))


def pivot_matrix(long: DataFrame, row: str, column: str, value: str, values: Sequence[str]) -> DataFrame:
    """One row a ``row``, one column a value; absent cells are null. The list of values is given, so no extra job."""
    return long.groupBy(row).pivot(column, list(values)).agg(F.max(value))


def matrix_missingness(long: DataFrame, rows: DataFrame, row: str, column: str) -> DataFrame:
    """Availability of each column over all rows of ``rows``, observed or not."""
    total = rows.agg(_count().alias("n_rows"))
    g = long.groupBy(column).agg(F.count_distinct(row).alias("n_observed"))
    return g.join(F.broadcast(total)).withColumn("missing", 1 - F.col("n_observed") / F.col("n_rows"))  # one row


def instance_qc(df: DataFrame, instance: str, mapped: Column, present: Column, positive: Column, usable: Column, length: Column) -> DataFrame:
    one = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    g = df.groupBy(instance).agg(one(mapped).alias("n_mapped"), one(present).alias("n_present"), one(positive).alias("n_positive"), one(usable).alias("n_usable"), F.max(length).alias("length"))
    for c in ("mapped", "present", "positive", "usable"):
        g = g.withColumn(f"{c}_coverage", F.round(F.col(f"n_{c}") / F.col("length"), 6))
    return g.withColumn("complete", F.col("n_usable") == F.col("length"))


def candidate_rollup(qc: DataFrame, keys: list[str], coverage: str, complete: str) -> DataFrame:
    c = F.col(coverage)
    return qc.groupBy(*keys).agg(_count().alias("n_instances"), F.min(c).alias("min_coverage"), F.max(c).alias("max_coverage"), F.median(c).alias("median_coverage"), F.bool_or(complete).alias("any_complete"), F.bool_and(complete).alias("all_complete"))


def counts_by_unit(units: DataFrame, unit: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of each table by unit; every unit stays, with 0."""
    out = units.select(unit).distinct()
    for name, t in tables.items():
        g = t.groupBy(F.col(unit).alias("_u")).agg(_count().alias(name))
        out = out.join(g, F.col(unit) == F.col("_u"), "left").drop("_u").fillna(0, [name])
    return out


def threshold_sensitivity(qc: DataFrame, levels: Sequence[float], coverage: str, instance: str, entry: str, unit: str) -> DataFrame:
    """For each level the instances, entries and units kept, and the units lost, in order. One pass for all levels."""
    keep = [F.col(coverage) >= F.lit(x) for x in levels]
    aggs = []
    for i, k in enumerate(keep):
        aggs += [F.count_distinct(F.when(k, F.col(c))).alias(f"{n}{i}") for n, c in (("a", instance), ("b", entry), ("c", unit))]
        aggs.append(F.array_sort(F.collect_set(F.when(k, F.col(unit)))).alias(f"k{i}"))
    g = qc.agg(*aggs, F.array_sort(F.collect_set(unit)).alias("units"))
    each = F.array(*(F.struct(F.lit(float(x)).alias("level"), F.col(f"a{i}").alias("n_instances"), F.col(f"b{i}").alias("n_entries"), F.col(f"c{i}").alias("n_units"), F.concat_ws(",", F.array_except("units", f"k{i}")).alias("lost")) for i, x in enumerate(levels)))
    return g.select(F.explode(each).alias("r")).select("r.*")


def threshold_attrition(qc: DataFrame, units: DataFrame, levels: Sequence[float], coverage: str, unit: str) -> DataFrame:
    """Unit x level: RETAINED, LOST, or NO_DATA for units without rows; best coverage."""
    best = qc.groupBy(F.col(unit).alias("_u")).agg(F.max(coverage).alias("best"))
    j = units.join(best, F.col(unit) == F.col("_u"), "left").drop("_u").withColumn("level", F.explode(F.array(*(F.lit(float(x)) for x in levels))))
    return j.withColumn("status", F.when(F.col("best").isNull(), "NO_DATA").when(F.col("best") >= F.col("level"), "RETAINED").otherwise("LOST"))


def any_all_threshold(qc: DataFrame, keys: list[str], coverage: str, level: float) -> DataFrame:
    ok = F.col(coverage) >= level
    return qc.groupBy(*keys).agg(F.bool_or(ok).alias("any_ge"), F.bool_and(ok).alias("all_ge"))


def heterogeneity(qc: DataFrame, keys: list[str], coverage: str, level: float = 0.05) -> DataFrame:
    g = qc.groupBy(*keys).agg(_count().alias("n"), (F.max(coverage) - F.min(coverage)).alias("spread")).where("n > 1")
    return g.withColumn("heterogeneous", F.col("spread") >= level)


def change_audit(df: DataFrame, keys: list[str], before: Column, after: Column) -> DataFrame:
    """Groups on whose row counts two definitions disagree."""
    return df.groupBy(*keys).agg(_when(before).alias("n_before"), _when(after).alias("n_after")).where("n_before <> n_after")


def vote_consensus(df: DataFrame, keys: list[str], state: str, states: Sequence[str], voter: str) -> DataFrame:
    """Votes for each state; ties go to the earlier state."""
    g = df.groupBy(*keys).agg(_count().alias("n_votes"), F.count_distinct(voter).alias("n_voters"), *(_when(F.col(state) == s).alias(f"n_{s}") for s in states))
    top, win = F.greatest(*(F.col(f"n_{s}") for s in states)), F.when(F.lit(False), "")
    for s in states:
        win = win.when(F.col(f"n_{s}") == top, s)
    return g.withColumn("winner", win).withColumn("fraction", top / F.col("n_votes"))


def contact_consensus(df: DataFrame, keys: list[str], entry: str, contact: Column, levels: Sequence[float] = (0.1, 0.25, 0.5), least: int = 3) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count_distinct(entry).alias("n_entries"), F.count_distinct(F.when(contact, F.col(entry))).alias("n_contacting")).where(F.col("n_entries") >= least)
    g = g.withColumn("fraction", F.col("n_contacting") / F.col("n_entries"))
    return g.withColumns({f"ge_{round(x * 100)}": F.col("fraction") >= x for x in levels})


def dominance(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Distinct labels, the most frequent (the smallest among ties) and its share."""
    g = df.groupBy(*keys, label).agg(_count().alias("n"))
    g = g.groupBy(*keys).agg(_count().alias("n_labels"), F.sum("n").alias("total"), F.min(F.struct(-F.col("n"), F.col(label).alias("label"))).alias("top"))
    g = g.withColumn("share", -F.col("top.col1") / F.col("total"))
    return g.select(*keys, "n_labels", F.col("top.label").alias("top_label"), "share", (F.col("share") > 0.5).alias("dominated"))


def stratify(df: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """The same aggregates by first and by first x second, in one table."""
    return df.groupingSets([[first], [first, second]], first, second).agg(_count().alias("n"), F.median(value).alias("median"), F.grouping(second).cast("int").alias("total"))


def anomaly_union(parts: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Filtered tables as rows (anomaly, key, n)."""
    out = None
    for name, t in parts.items():
        p = t.groupBy(F.col(key).cast("string").alias("key")).agg(_count().alias("n")).select(F.lit(name).alias("anomaly"), "key", "n")
        out = p if out is None else out.unionByName(p)
    return out


def state_eligibility(units: DataFrame, entries: DataFrame, unit: str, state: str, tiers: Sequence[int] = (5, 3)) -> DataFrame:
    g = entries.groupBy(F.col(unit).alias("_u")).agg(*(_when(F.col(state) == s).alias(f"n_{s.lower()}") for s in ("APO", "HOLO", "AMBIGUOUS")))
    out = units.join(g, F.col(unit) == F.col("_u"), "left").drop("_u").fillna(0, ["n_apo", "n_holo", "n_ambiguous"])
    low = F.least("n_apo", "n_holo")
    return out.withColumn("tier", F.when(low >= tiers[0], "PRIMARY").when(low >= tiers[1], "EXPLORATORY").otherwise("NOT_ELIGIBLE"))


def effect_summary(tests: DataFrame, unit: str, segment: str, delta: str) -> DataFrame:
    d = F.col(delta)
    return tests.groupBy(unit).agg(
        _count().alias("n_tested"), F.median(d).alias("median_delta"), F.avg((d > 0).cast("int")).alias("share_up"), F.avg((d < 0).cast("int")).alias("share_down"),
        F.min(F.struct(d, F.col(segment).alias("s")))["s"].alias("lowest"), F.min(F.struct(-d, F.col(segment).alias("s")))["s"].alias("highest"),
    )


def overrepresentation(df: DataFrame, unit: str, top: int = 5) -> DataFrame:
    """Entries by unit, largest first, and the share of the largest ``top``. The window is over one row a unit."""
    g = df.groupBy(unit).agg(_count().alias("n"))
    g = g.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("n"), unit)))
    all_n, top_n = F.sum("n").over(W.partitionBy(F.lit(0))), F.sum(F.when(F.col("rank") <= top, F.col("n"))).over(W.partitionBy(F.lit(0)))
    return g.withColumn("top_share", top_n / all_n)


def feature_support(long: DataFrame, vocabulary: DataFrame, segment: str, unit: str, n_units: int) -> DataFrame:
    """Support of each segment; members of the vocabulary that never occur have 0."""
    g = long.groupBy(F.col(segment).alias("_s")).agg(F.count_distinct(unit).alias("n_units"), F.median("n_entries").alias("median_entries"))
    return vocabulary.join(g, F.col(segment) == F.col("_s"), "left").drop("_s").fillna(0, ["n_units"]).withColumn("support", F.col("n_units") / n_units)


def candidate_feature_sets(support: DataFrame, long: DataFrame, segment: str, unit: str, levels: Sequence[float]) -> DataFrame:
    """At each level of support: features, and units that have all of them."""
    at = support.withColumn("level", F.explode(F.array(*(F.lit(float(x)) for x in levels)))).where(F.col("support") >= F.col("level"))
    n = at.groupBy("level").agg(_count().alias("n_features"))
    have = at.select("level", segment).join(long.select(segment, unit).distinct().hint("merge"), segment).groupBy("level", unit).agg(_count().alias("have"))
    done = have.join(n.hint("merge"), "level").groupBy("level").agg(_when(F.col("have") == F.col("n_features")).alias("complete_units"), F.max("n_features").alias("n_features"))
    return done


def cohort_rule(long: DataFrame, units: DataFrame, unit: str, features: Sequence[str], segment: str, least: float = 0.6) -> DataFrame:
    g = long.where(F.col(segment).isin(*features)).groupBy(F.col(unit).alias("_u")).agg(F.count_distinct(segment).alias("n_observed"))
    out = units.join(g, F.col(unit) == F.col("_u"), "left").drop("_u").fillna(0, ["n_observed"])
    out = out.withColumn("observed_fraction", F.col("n_observed") / len(features))
    return out.withColumn("included", F.col("observed_fraction") >= least).withColumn("reason", F.when(F.col("included"), "ENOUGH_OBSERVED").when(F.col("n_observed") == 0, "NOTHING_OBSERVED").otherwise("TOO_FEW_OBSERVED"))


def crosstab_2x2(df: DataFrame, keys: list[str], a: Column, b: Column) -> DataFrame:
    g = df.groupBy(*keys).agg(_when(a & b).alias("n11"), _when(a & ~b).alias("n10"), _when(~a & b).alias("n01"), _when(~a & ~b).alias("n00"))
    rows, cols = [(F.col("n11") + F.col("n10")), (F.col("n01") + F.col("n00"))], [(F.col("n11") + F.col("n01")), (F.col("n10") + F.col("n00"))]
    return g.withColumn("degenerate", F.least(*rows, *cols) == 0)


def missingness_profile(qc: DataFrame, total: str, usable: str, edges: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """Histogram of the usable fraction over instances, with the quantiles of missing counts in each bin."""
    from .classify import bin_by_edges

    f = F.col(usable) / F.col(total)
    g = qc.withColumn("bin", bin_by_edges(f, edges, labels, exact_top="ALL")).withColumn("missing", F.col(total) - F.col(usable))
    return g.groupBy("bin").agg(_count().alias("n"), F.median("missing").alias("median_missing"), F.max("missing").alias("max_missing"))


def support_totals(df: DataFrame, unit: str, columns: Sequence[str], least: int = 3) -> DataFrame:
    """Sums by unit and a grand total (null unit), with the balance of the first two columns."""
    g = df.rollup(unit).agg(*(F.sum(c).alias(c) for c in columns))
    low, both = F.least(*columns[:2]), F.col(columns[0]) + F.col(columns[1])
    return g.withColumn("balance", F.when(both == 0, "NO_DATA").when(low >= least, "ADEQUATE").otherwise("INSUFFICIENT"))


def selected_map(obs: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    return obs.join(selected.select(key).distinct(), key, "left_semi")


def list_partners(df: DataFrame, keys: DataFrame, key: str, category: str, name: str) -> DataFrame:
    """Presence and one text of "category (name)" in order, for every key."""
    text = F.array_join(F.array_sort(F.collect_set(F.concat(F.col(category), F.lit(" ("), F.col(name), F.lit(")")))), "; ")
    g = df.groupBy(F.col(key).alias("_k")).agg(text.alias("partners"))
    out = keys.join(g, F.col(key) == F.col("_k"), "left").drop("_k")
    return out.withColumn("has_partner", F.col("partners").isNotNull()).fillna("", ["partners"])


def dataset_summary(df: DataFrame, unit: str, entry: str) -> DataFrame:
    """One row: totals, units with few and with several entries."""
    g = df.groupBy(unit).agg(F.count_distinct(entry).alias("n"), _count().alias("rows"))
    return g.agg(_count().alias("n_units"), F.sum("rows").alias("n_rows"), F.sum("n").alias("n_entries"), _when(F.col("n") <= 2).alias("units_1_2"), _when(F.col("n") >= 3).alias("units_3_up"))
