"""Joins: checked left joins, grids, interval and position ranges by buckets, radius contacts by cells.

Range joins are equi-joins on a bucket and an exact filter, so no plan has a nested loop over data tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tierstats.sources.shared import staged

from .contracts import grain_check
from .ordered import Ordered
from .windows import merge_intervals


def join_m1(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join that fails if the right side is not unique."""
    return left.join(grain_check(right, on), on, "left")


def build_inventory(base: DataFrame, first: DataFrame, first_on: list[str], second: DataFrame, second_on: list[str]) -> DataFrame:
    """Two many-to-one left joins and presence flags; the rows of ``base`` stay as they are."""
    a = join_m1(base, first.withColumn("has_first", F.lit(True)), first_on)
    b = join_m1(a, second.withColumn("has_second", F.lit(True)), second_on)
    return b.fillna(False, ["has_first", "has_second"])


def members(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def scope_difference(a: DataFrame, b: DataFrame, unit: str, item: str) -> DataFrame:
    """Per unit: items in both, only in a (missing from b), only in b (outside)."""
    x = a.select(F.col(unit), F.col(item)).distinct().withColumn("_a", F.lit(1))
    y = b.select(F.col(unit), F.col(item)).distinct().withColumn("_b", F.lit(1))
    j = x.join(y, [unit, item], "full")
    return j.groupBy(unit).agg(F.count(F.col("_a") + F.col("_b")).alias("n_matched"), F.count(F.when(F.col("_b").isNull(), 1)).alias("n_missing"), F.count(F.when(F.col("_a").isNull(), 1)).alias("n_outside"))


def dense_grid(ref: DataFrame, keys: list[str], start: Column, end: Column, pos: str = "position") -> DataFrame:
    return ref.select(*keys, F.explode(F.sequence(start, end)).alias(pos))


def grid_join(ref: DataFrame, keys: list[str], start: Column, end: Column, seen: DataFrame, pos: str = "position") -> DataFrame:
    """One row for each key and position, observed or not, with ``n`` = rows seen there."""
    g = dense_grid(ref, keys, start, end, pos)
    n = seen.groupBy(*keys, pos).agg(F.count(F.lit(1)).alias("n"))
    # the grid comes from a generator, whose size Spark cannot estimate
    return g.join(n.hint("merge"), [*keys, pos], "left").fillna(0, ["n"])


def coordinate_map(regions: DataFrame, key: str) -> DataFrame:
    """regions (key, qb, qe, tb, te): position pairs (q, t) of each key; a key with unequal lengths, wrong order or a
    position that maps to two is REVIEW_NEEDED and has no pair. Gaps are not filled."""
    r = regions.withColumn("_bad", (F.col("qe") - F.col("qb") != F.col("te") - F.col("tb")) | (F.col("qe") < F.col("qb")))
    pairs = r.where(~F.col("_bad")).select(key, F.col("qb"), F.col("tb"), F.explode(F.sequence(F.lit(0), F.col("qe") - F.col("qb"))).alias("i")).select(key, (F.col("qb") + F.col("i")).alias("q"), (F.col("tb") + F.col("i")).alias("t")).distinct()
    twice = pairs.groupBy(key, "q").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)
    bad = r.where("_bad").select(key).unionByName(twice).distinct()
    return pairs.join(bad.hint("merge"), key, "left_anti")


def bucketed_positions(ranges: DataFrame, b: str, e: str, width: int) -> DataFrame:
    """A row for each bucket that an inclusive range touches."""
    return ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(b) / width), F.floor(F.col(e) / width))))


def interval_label_join(pos: DataFrame, ranges: DataFrame, keys: list[str], p: str, b: str, e: str, label: str, priority: Sequence[str], default: str, width: int = 32) -> DataFrame:
    """Label of the range that holds the position, by priority; ``default`` without one."""
    r = bucketed_positions(ranges.select(*keys, F.col(b).alias("_b"), F.col(e).alias("_e"), F.col(label).alias("_l")), "_b", "_e", width)
    d = pos.withColumn("_bucket", F.floor(F.col(p) / width))
    hit = d.join(r.hint("merge"), [*keys, "_bucket"]).where((F.col(p) >= F.col("_b")) & (F.col(p) <= F.col("_e")))
    best = hit.groupBy(*keys, p).agg(F.min(F.array_position(F.array(*(F.lit(x) for x in priority)), F.col("_l"))).alias("_o"))
    named = F.coalesce(F.get(F.array(*(F.lit(x) for x in priority)), (F.col("_o") - 1).cast("int")), F.lit(default))
    return pos.join(best.hint("merge"), [*keys, p], "left").withColumn("label", named).drop("_o")


def intersect_reference(ivals: DataFrame, keys: list[str], b: str, e: str, ref_b: int, ref_e: int) -> DataFrame:
    """Overlap of the merged intervals with one reference: length, coverage, full span, what is left over."""
    m = merge_intervals(ivals, keys, b, e)
    over = F.greatest(F.lit(0), F.least(F.col("end"), F.lit(ref_e)) - F.greatest(F.col("start"), F.lit(ref_b)) + 1)
    g = m.groupBy(*keys).agg(F.sum(over).alias("overlap"), F.sum(F.col("end") - F.col("start") + 1).alias("total"))
    size = ref_e - ref_b + 1
    return g.withColumns({"coverage": F.col("overlap") / size, "full_span": F.col("overlap") == size, "outside": F.col("total") - F.col("overlap")})


def overlap_fraction(a: DataFrame, b: DataFrame, width: int = 64, partner: str | None = None) -> DataFrame:
    """a, b (k, b, e): shared length of the merged spans of equal k over the shorter span, and its class.

    partner: a column of b that names what a key is compared with. Then every key of a has a row, with n_partners, and a
    key without exactly one partner is AMBIGUOUS, whatever it overlaps."""
    if partner:
        n = b.where(F.col(partner).isNotNull()).groupBy(F.col("k").alias("_k")).agg(F.count_distinct(partner).alias("n_partners"))
        one = n.where("n_partners = 1").select(F.col("_k").alias("k"))
        found = overlap_fraction(a, b.join(one.hint("merge"), "k", "left_semi").where(F.col(partner).isNotNull()), width)
        every = a.select("k").distinct().join(n.hint("merge"), F.col("k") == F.col("_k"), "left").drop("_k").fillna(0, ["n_partners"])
        return every.join(found.hint("merge"), "k", "left").withColumn("relation", F.coalesce("relation", F.lit("AMBIGUOUS")))
    x, y = merge_intervals(a, ["k"], "b", "e"), merge_intervals(b, ["k"], "b", "e")
    xs = bucketed_positions(x.select("k", F.col("start").alias("xs"), F.col("end").alias("xe")), "xs", "xe", width)
    ys = bucketed_positions(y.select("k", F.col("start").alias("ys"), F.col("end").alias("ye")), "ys", "ye", width)
    lo, hi = F.greatest("xs", "ys", F.col("_bucket") * width), F.least("xe", "ye", F.col("_bucket") * width + width - 1)
    over = xs.join(ys.hint("merge"), ["k", "_bucket"]).groupBy("k").agg(F.sum(F.greatest(F.lit(0), hi - lo + 1)).alias("overlap"))
    size = lambda t, n: t.groupBy("k").agg(F.sum(F.col("end") - F.col("start") + 1).alias(n))
    j = size(x, "len_a").join(size(y, "len_b"), "k").join(over.hint("merge"), "k", "left").fillna(0, ["overlap"])
    f = F.col("overlap") / F.least("len_a", "len_b")
    return j.withColumn("fraction", f).withColumn("relation", F.when(F.col("fraction") <= 0.05, "DISJOINT").when(F.col("fraction") >= 0.8, "SAME").otherwise("AMBIGUOUS"))


def boundary_sensitivity(ivals: DataFrame, keys: list[str], b: str, e: str, ref_a: tuple[int, int], ref_b: tuple[int, int], level: float) -> DataFrame:
    """Coverage under two references, and whether pass or fail at ``level`` changes."""
    x = intersect_reference(ivals, keys, b, e, *ref_a).select(*keys, F.col("coverage").alias("coverage_a"))
    y = intersect_reference(ivals, keys, b, e, *ref_b).select(*keys, F.col("coverage").alias("coverage_b"))
    return x.join(y, keys).withColumn("changed", (F.col("coverage_a") >= level) != (F.col("coverage_b") >= level))


def radius_contacts(points: DataFrame, probes: DataFrame, entry: str, point_id: str, probe_id: str, r: float) -> DataFrame:
    """(entry, probe, point, distance) of all pairs within r; x, y, z are the coordinates.

    Points go to cells of side r, each probe to the 27 cells around its own: an equi-join and an exact filter."""
    cell = lambda c: F.floor(F.col(c) / r)
    p = points.select(F.col(entry), F.col(point_id).alias("point"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), cell("x").alias("cx"), cell("y").alias("cy"), cell("z").alias("cz"))
    near = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    q = probes.select(F.col(entry), F.col(probe_id).alias("probe"), "x", "y", "z", cell("x").alias("ax"), cell("y").alias("ay"), cell("z").alias("az"))
    q = q.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near)).withColumn("dz", F.explode(near))
    q = q.select(entry, "probe", "x", "y", "z", (F.col("ax") + F.col("dx")).alias("cx"), (F.col("ay") + F.col("dy")).alias("cy"), (F.col("az") + F.col("dz")).alias("cz"))
    d = F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2 + (F.col("z") - F.col("pz")) ** 2)
    return q.join(p.hint("merge"), [entry, "cx", "cy", "cz"]).withColumn("distance", d).where(F.col("distance") <= r).select(entry, "probe", "point", "distance")


def probe_contacts(points: DataFrame, probes: DataFrame, entry: str, position: str, probe_id: str, occupancy: str, near: float = 4.5, far: float = 5.0, inventory: bool = True) -> DataFrame:
    """(entry, probe, n_atoms, min_distance, within_near, within_far, positions): each probe, of many atoms, against the points.

    points (entry, position, x, y, z, occupancy) and probes (entry, probe, x, y, z, occupancy), one row an atom. Only atoms with an
    occupancy above 0 count. Of a probe without any the inventory form takes all atoms, the pocket form (inventory=False) skips
    it. ``positions`` are the distinct positions within ``near``, sorted. Where nothing is within ``far`` the radius is doubled
    for the probes that are left, until each has its nearest point or its entry has none (null, false, no positions).
    """
    some = points.where(F.coalesce(F.col(occupancy), F.lit(0)) > 0).select(entry, F.col(position).alias("_p"), "x", "y", "z")
    own = probes.select(entry, F.col(probe_id).alias("probe"), "x", "y", "z", (F.coalesce(F.col(occupancy), F.lit(0)) > 0).alias("_on"))
    has = own.groupBy(F.col(entry).alias("_e"), F.col("probe").alias("_q")).agg(F.max("_on").alias("_has"))
    own = own.join(has.hint("merge"), (F.col(entry) == F.col("_e")) & (F.col("probe") == F.col("_q")))
    own = own.where(F.col("_on") | ~F.col("_has") if inventory else F.col("_on")).select(entry, "probe", "x", "y", "z")
    own = staged(own.withColumn("_atom", F.monotonically_increasing_id()), "contact-probes")
    some = staged(some, "contact-points")
    left, found, r = own.withColumn("_id", F.struct("probe", "_atom")), None, far
    reach = own.unionByName(some.select(entry, "x", "y", "z"), allowMissingColumns=True).agg(*(F.max(c) - F.min(c) for c in "xyz")).first()
    wide = 2 * sum(x or 0 for x in reach) + far
    while r <= 2 * wide:
        hit = radius_contacts(some, left, entry, "_p", "_id", r).groupBy(entry, F.col("probe.probe").alias("probe")).agg(
            F.min("distance").alias("min_distance"), F.array_sort(F.collect_set(F.when(F.col("distance") <= near, F.col("point")))).alias("positions")
        )
        hit = staged(hit, "contact-found")
        found = hit if found is None else found.unionByName(hit)
        left = staged(left.join(hit.select(F.col(entry).alias("_e"), F.col("probe").alias("_q")).hint("merge"), (F.col(entry) == F.col("_e")) & (F.col("probe") == F.col("_q")), "left_anti"), "contact-left")
        # probes whose entry has no point are not looked for again
        left = left.join(some.select(F.col(entry).alias("_e")).distinct().hint("merge"), F.col(entry) == F.col("_e"), "left_semi")
        if left.isEmpty():
            break
        r *= 2
    n = own.groupBy(entry, "probe").agg(F.count(F.lit(1)).alias("n_atoms"))
    found = found.select(F.col(entry).alias("_e"), F.col("probe").alias("_q"), "min_distance", "positions")
    out = n.join(found.hint("merge"), (F.col(entry) == F.col("_e")) & (F.col("probe") == F.col("_q")), "left")
    within = lambda x: F.coalesce(F.col("min_distance") <= x, F.lit(False))
    return out.select(entry, "probe", "n_atoms", "min_distance", within(near).alias("within_near"), within(far).alias("within_far"), F.coalesce("positions", F.array().cast(found.schema["positions"].dataType)).alias("positions"))


def nearest_within(df: DataFrame, sites: DataFrame, keys: list[str], p: str, site_pos: str, w: int = 3) -> DataFrame:
    """Nearest site position within w, by (distance, position); null without one.

    Positions of a key are cut into pieces of length w; a site is put into its own piece and the two beside it. In a piece the last site
    up to a row and the first from it on are its candidates, so a site is three rows, not one for each position in reach."""
    step, rest = max(w, 1), [c for c in df.columns if c not in (*keys, p)]
    piece = F.floor(F.col(p) / step)
    s = sites.select(*keys, F.col(site_pos).alias(p)).distinct().where(F.col(p).isNotNull())
    s = s.select(*keys, p, F.col(p).alias("_site"), F.lit(False).alias("_is_row"), F.explode(F.array(piece - 1, piece, piece + 1)).alias("_piece"))
    line = df.withColumns({"_is_row": F.lit(True), "_piece": piece}).unionByName(s, allowMissingColumns=True)
    by = W.partitionBy(*keys, "_piece")
    upto = lambda *order: F.last("_site", ignorenulls=True).over(by.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    d = line.withColumns({"_a": upto(F.col(p), F.col("_is_row")), "_b": upto(F.col(p).desc(), F.col("_is_row"))}).where("_is_row")
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    near = lambda c: F.when(known & (F.abs(F.col(c) - F.col(p)) <= w), F.struct(F.abs(F.col(c) - F.col(p)).alias("d"), F.col(c).alias("s")))
    d = d.withColumn("_n", F.least(near("_a"), near("_b")))
    return d.select(*keys, p, *rest, F.col("_n.s").alias("nearest"), F.col("_n.d").alias("distance"))


def bracketing_neighbours(grid: DataFrame, keys: list[str], p: str, call: str) -> DataFrame:
    """Positions without a call: between two calls loop_A_B, else LOOP_UNCERTAIN with a reason."""
    w = W.partitionBy(*keys).orderBy(p)
    before = F.last(call, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    after = F.first(call, ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    d = grid.withColumns({"_b": before, "_a": after})
    both = F.col("_b").isNotNull() & F.col("_a").isNotNull()
    name = F.when(F.col(call).isNotNull(), F.col(call)).when(both, F.concat_ws("_", F.lit("loop"), "_b", "_a")).otherwise("LOOP_UNCERTAIN")
    why = F.when(F.col(call).isNotNull() | both, "").when(F.col("_a").isNotNull(), "NO_CALL_BEFORE").when(F.col("_b").isNotNull(), "NO_CALL_AFTER").otherwise("NO_CALLS")
    return d.withColumns({"name": name, "reason": why}).drop("_b", "_a")


def unit_site_availability(units: DataFrame, unit: str, sites: Sequence[str], defs: DataFrame, enough: int) -> DataFrame:
    """Every unit x site: AVAILABLE, PARTIAL or UNRESOLVED, and the modal confidence."""
    g = units.select(unit).withColumn("site", F.explode(F.array(*(F.lit(s) for s in sites))))
    d = defs.groupBy(unit, "site").agg(F.count(F.lit(1)).alias("n"), F.mode("confidence", deterministic=True).alias("confidence"))
    j = g.join(d.hint("merge"), [unit, "site"], "left").fillna(0, ["n"])
    return j.withColumn("status", F.when(F.col("n") == 0, "UNRESOLVED").when(F.col("n") >= enough, "AVAILABLE").otherwise("PARTIAL"))


def eligibility_grid(long: DataFrame, units: DataFrame, unit: str, group: str, segment: str, least: int = 3) -> DataFrame:
    """segment x group: units in all, observed, missing, and whether enough are observed."""
    total = units.groupBy(group).agg(F.count_distinct(unit).alias("n_total"))
    g = long.select(segment).distinct().join(F.broadcast(total))  # one row a group
    seen = long.groupBy(segment, group).agg(F.count_distinct(unit).alias("n_observed"))
    j = g.join(seen, [segment, group], "left").fillna(0, ["n_observed"])
    return j.withColumns({"n_missing": F.col("n_total") - F.col("n_observed"), "eligible": F.col("n_observed") >= least})


def set_overlap(seg_pos: DataFrame, site_pos: DataFrame, unit: str, segment: str, site: str, pos: str) -> DataFrame:
    """Sites that overlap a (unit, segment), with counts; a row without a site where there is none."""
    size = seg_pos.groupBy(unit, segment).agg(F.count(F.lit(1)).alias("n_positions"))
    hit = seg_pos.join(site_pos, [unit, pos]).groupBy(unit, segment, site).agg(F.count(F.lit(1)).alias("n_overlap"))
    return size.join(hit, [unit, segment], "left").fillna(0, ["n_overlap"]).withColumn("fraction", F.col("n_overlap") / F.col("n_positions"))


def pair_identity(seqs: DataFrame, unit: str, pos: str, symbol: str) -> DataFrame:
    """Pairs of units that share a position: shared positions and the share of equal symbols there. The result has a row for each
    such pair, so it grows with the square of the units that share positions."""
    a = seqs.select(F.col(unit).alias("u1"), F.col(pos).alias("_p"), F.col(symbol).alias("s1"))
    b = seqs.select(F.col(unit).alias("u2"), F.col(pos).alias("_p"), F.col(symbol).alias("s2"))
    j = a.join(b.hint("merge"), "_p").where("u1 < u2")
    return j.groupBy("u1", "u2").agg(F.count(F.lit(1)).alias("n_shared"), F.avg((F.col("s1") == F.col("s2")).cast("int")).alias("identity"))


def relative_index(seqs: DataFrame, unit: str, pos: str) -> DataFrame:
    """``seqs`` with ``index``: the number of a unit's position in its order, from 0."""
    o = Ordered(seqs, [unit], [pos])
    return o.running_sum(o.rows, F.lit(1), "index").withColumn("index", F.col("index") - 1).drop("_part")


def disjoint_pairs(ranges: DataFrame, unit: str, lo: str, hi: str) -> DataFrame:
    """One row (n_units, n_pairs, n_disjoint): how many pairs of the units' inclusive ranges share no position.

    A pair is disjoint if one range ends before the other begins, so for each beginning the ends before it are counted, by
    running sums over ends and beginnings in one order: no pair is made."""
    ends = ranges.select(F.col(hi).alias("_at"), F.lit(1).alias("_kind"), F.lit(1).cast("long").alias("_end"), F.col(unit).alias("_u"))
    starts = ranges.select(F.col(lo).alias("_at"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_end"), F.col(unit).alias("_u"))
    o = Ordered(ends.unionByName(starts), [], ["_at", "_kind", "_u"])  # a range that ends where another begins is not before it
    d = o.running_sum(o.rows, F.col("_end"), "_before")
    n = F.count(F.when(F.col("_kind") == 0, 1))
    return d.agg(n.alias("n_units"), F.floor(n * (n - 1) / 2).alias("n_pairs"), F.coalesce(F.sum(F.when(F.col("_kind") == 0, F.col("_before"))), F.lit(0)).alias("n_disjoint"))


def identity_summary(seqs: DataFrame, unit: str, pos: str, symbol: str) -> DataFrame:
    """One row: how well positions line units up. n_units, n_pairs and share_disjoint of the units' ranges; n_sharing and
    identity_position, the mean share of equal symbols at identical positions over the pairs that share any; identity_relative, the
    same by relative index over all pairs, as far as the shorter unit goes; chance, the sum of the squared shares of the symbols."""
    ranges = seqs.groupBy(unit).agg(F.min(pos).alias("_lo"), F.max(pos).alias("_hi"))
    apart = disjoint_pairs(ranges, unit, "_lo", "_hi")
    same = pair_identity(seqs, unit, pos, symbol).agg(F.count(F.lit(1)).alias("n_sharing"), F.avg("identity").alias("identity_position"))
    relative = pair_identity(relative_index(seqs, unit, pos), unit, "index", symbol).agg(F.avg("identity").alias("identity_relative"))
    n = seqs.groupBy(symbol).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    chance = n.agg((F.sum(F.col("_n") * F.col("_n")) / (F.sum("_n") * F.sum("_n"))).alias("chance"))
    out = apart.join(F.broadcast(same)).join(F.broadcast(relative)).join(F.broadcast(chance))  # one row each
    return out.withColumn("share_disjoint", F.col("n_disjoint") / F.col("n_pairs"))


def crosscheck(obs: DataFrame, listed: DataFrame, keys: list[str], present: Column, positive: Column) -> DataFrame:
    """Rows where a list of unobserved positions and the observations disagree."""
    j = obs.join(listed.select(*keys).distinct().withColumn("_listed", F.lit(True)), keys, "left")
    has = F.coalesce(F.col("_listed"), F.lit(False))
    kind = F.when(has & positive, "LISTED_BUT_POSITIVE").when(has & present, "LISTED_BUT_ZERO").when(~has & ~present, "ABSENT_NOT_LISTED")
    return j.withColumn("category", kind).drop("_listed").where(F.col("category").isNotNull())


def residual_audit(obs: DataFrame, listed: DataFrame, keys: list[str], present: Column, positive: Column, expected: Mapping[str, Column]) -> DataFrame:
    """The rows that a list of unobserved positions does not have, and that were not observed for all that: case NO_RECORD, or ZERO_ONLY for
    those with a record and no positive one; EXPLAINED if all conditions of ``expected`` (name -> what should hold) do, else
    REVIEW_NEEDED, with the names of those that do not as ``reason``."""
    rest = obs.join(listed.select(*keys).distinct().hint("merge"), keys, "left_anti")
    rest = rest.withColumn("case", F.when(~present, "NO_RECORD").when(~positive, "ZERO_ONLY")).where(F.col("case").isNotNull())
    reasons = F.concat_ws("; ", *(F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in expected.items()))
    return rest.withColumn("reason", reasons).withColumn("status", F.when(F.col("reason") == "", "EXPLAINED").otherwise("REVIEW_NEEDED"))


def compare_runs(a: DataFrame, b: DataFrame, keys: list[str], effect: str, p: str, alpha: float = 0.05) -> DataFrame:
    x = a.select(*keys, F.col(effect).alias("effect_a"), F.col(p).alias("p_a"))
    j = x.join(b.select(*keys, F.col(effect).alias("effect_b"), F.col(p).alias("p_b")), keys)
    sa, sb = F.col("p_a") < alpha, F.col("p_b") < alpha
    return j.withColumns({"same_direction": F.signum("effect_a") == F.signum("effect_b"), "significance": F.when(sa & sb, "PRESERVED").when(sa, "LOST").when(sb, "GAINED").otherwise("NEITHER")})


def master_table(base: DataFrame, key: str, parts: dict[str, DataFrame]) -> DataFrame:
    """One row a key with the columns of all parts, and has_<part>; parts must be unique."""
    out = base
    for name, t in parts.items():
        out = join_m1(out, t.withColumn(f"has_{name}", F.lit(True)), [key]).fillna(False, [f"has_{name}"])
    return out


def unique_or_blank(df: DataFrame, keys: DataFrame, key: str, value: str) -> DataFrame:
    """The value of keys with exactly one row; blank with a note for several, blank for none."""
    g = df.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("_v"))
    j = keys.join(g, F.col(key) == F.col("_k"), "left").drop("_k").fillna(0, ["n"])
    return j.withColumns({value: F.when(F.col("n") == 1, F.col("_v")), "note": F.when(F.col("n") > 1, "SEVERAL_ROWS").otherwise("")}).drop("_v")


def refresh_columns(inv: DataFrame, key: str, computed: DataFrame, columns: list[str]) -> DataFrame:
    """Own earlier columns are dropped and attached anew, so a rerun gives the same table."""
    return inv.drop(*columns).join(computed.select(key, *columns), key, "left")


def instance_inventory(entities: DataFrame, key: str, instances: str) -> DataFrame:
    """An array of instances as rows; an entity without any stays as REVIEW_NEEDED."""
    d = entities.withColumn("instance", F.explode_outer(instances)).drop(instances)
    return d.withColumn("status", F.when(F.col("instance").isNull(), "REVIEW_NEEDED").otherwise("LISTED"))


#: One-letter symbols and their three-letter names (fixed values).
SYMBOLS = dict(zip("ARNDCQEGHILKMFPSTWYV", "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL".split(), strict=True))


def sequence_symbol(sequence: Column, pos: Column) -> Column:
    """Three-letter name of the symbol at a 1-based position, "" out of range or unknown."""
    names = F.create_map(*(F.lit(x) for p in SYMBOLS.items() for x in p))
    return F.when(pos >= 1, F.coalesce(F.try_element_at(names, F.substring(sequence, pos, F.lit(1))), F.lit(""))).otherwise("")
