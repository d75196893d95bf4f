"""Composite layers: segment maps, sites, matched controls, atlas and comparisons, out of the operators below them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tierstats.sources.shared import staged

from .classify import keyword_class, segment_category, state_from_evidence
from .joins import bracketing_neighbours, dense_grid, nearest_within, probe_contacts, radius_contacts
from .quantiles import quantiles
from .stats import bootstrap_ci, kruskal, mann_whitney, wilcoxon_one_sample
from .windows import bh_fdr, rank_min_desc, top_bottom_share

CONFIDENCE = ["HIGH", "MODERATE", "LOW"]


def topology_labels(run: DataFrame, bounds: DataFrame, unit: str, state: str, expected: int, near: tuple[int, int] = (5, 15)) -> DataFrame:
    """Names of the HELIX and SHEET runs of each unit: the first helix near the start is H1, the last near the end Hn,
    a single sheet with helices on both sides is beta_sheet; helices between are named by order only if the unit has
    the expected number of helices, else AMBIGUOUS."""
    h = run.where(F.col(state).isin("HELIX", "SHEET")).join(bounds, unit)
    w = W.partitionBy(unit, state)
    h = h.withColumns({"ord": F.row_number().over(w.orderBy("start")), "n": F.count(F.lit(1)).over(w)})
    u = W.partitionBy(unit)
    is_h = F.col(state) == "HELIX"
    h = h.withColumns({"first_h": F.min(F.when(is_h, F.col("start"))).over(u), "last_h": F.max(F.when(is_h, F.col("start"))).over(u), "n_h": F.count(F.when(is_h, 1)).over(u)})
    lead, trail = F.col("start") - F.col("lo"), F.col("hi") - F.col("end")
    level = lambda gap: F.when(gap <= near[0], "HIGH").when(gap <= near[1], "MODERATE")
    first, last = is_h & (F.col("ord") == 1) & (lead <= near[1]), is_h & (F.col("ord") == F.col("n")) & (trail <= near[1])
    sheet = (F.col(state) == "SHEET") & (F.col("n") == 1) & (F.col("first_h") < F.col("start")) & (F.col("last_h") > F.col("start"))
    by_order = is_h & (F.col("n_h") == expected)
    name = F.when(first, "H1").when(last, F.lit(f"H{expected}")).when(sheet, "beta_sheet").when(by_order, F.concat(F.lit("H"), F.col("ord").cast("string"))).otherwise("AMBIGUOUS")
    conf = F.when(first, level(lead)).when(last, level(trail)).when(sheet, "HIGH").when(by_order, "MODERATE").otherwise("LOW")
    return h.select(unit, state, "start", "end", name.alias("segment"), conf.alias("confidence"))


def transfer_labels(corr: DataFrame, labels: DataFrame, target_runs: DataFrame, usable: float = 3.5, strong: float = 0.5, weak: float = 0.3) -> DataFrame:
    """corr (unit, template, score, q, t), labels (template, t, segment, cls), target_runs (unit, cls, start, end).

    Each unit x segment takes the usable template of best (score, pairs, id) that offers the segment, projects its
    positions and becomes the run of the expected class with most overlap; without a run there is no label. Confidence
    is the share of projected positions in the run."""
    # positions come from generators, whose size Spark cannot estimate
    hit = corr.where(F.col("score") >= usable).join(labels.hint("merge"), ["template", "t"])
    offer = hit.groupBy("unit", "segment", "cls", "template").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("aligned"))
    best = offer.withColumn("_r", F.row_number().over(W.partitionBy("unit", "segment").orderBy(F.desc("score"), F.desc("aligned"), "template"))).where("_r = 1").drop("_r", "score", "aligned")
    pos = hit.select("unit", "segment", "template", "q").join(best.hint("merge"), ["unit", "segment", "template"])
    n = pos.groupBy("unit", "segment").agg(F.count(F.lit(1)).alias("n"))
    grid = target_runs.withColumn("q", F.explode(F.sequence("start", "end")))
    over = pos.join(grid.hint("merge"), ["unit", "cls", "q"]).groupBy("unit", "segment", "template", "start", "end").agg(F.count(F.lit(1)).alias("overlap"))
    top = over.withColumn("_r", F.row_number().over(W.partitionBy("unit", "segment").orderBy(F.desc("overlap"), "start"))).where("_r = 1").drop("_r")
    share = F.col("overlap") / F.col("n")
    out = top.join(n.hint("merge"), ["unit", "segment"]).withColumn("confidence", F.when(share >= strong, "HIGH").when(share >= weak, "MODERATE").otherwise("LOW"))
    return out.select("unit", "segment", "template", "start", "end", "overlap", "n", "confidence")


def rescue_labels(placed: DataFrame, core: Sequence[str], corr: DataFrame, labels: DataFrame, target_runs: DataFrame, n: int = 10) -> DataFrame:
    """Core segments a unit still lacks, from up to n further templates in score order: the first whose projection
    overlaps a matching run by max(3, 0.3 x length) wins."""
    units = corr.select("unit").distinct().withColumn("segment", F.explode(F.array(*(F.lit(s) for s in core))))
    gap = units.join(placed.select("unit", "segment").hint("merge"), ["unit", "segment"], "left_anti")
    order = corr.groupBy("unit", "template").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(W.partitionBy("unit").orderBy(F.desc("score"), "template"))).where(F.col("rank") <= n)
    hit = corr.drop("score").join(labels.hint("merge"), ["template", "t"]).join(gap.hint("merge"), ["unit", "segment"]).join(order.select("unit", "template", "rank").hint("merge"), ["unit", "template"])
    size = hit.groupBy("unit", "segment", "template").agg(F.count(F.lit(1)).alias("len"))
    grid = target_runs.withColumn("q", F.explode(F.sequence("start", "end")))
    over = hit.join(grid.hint("merge"), ["unit", "cls", "q"]).groupBy("unit", "segment", "template", "rank", "start", "end").agg(F.count(F.lit(1)).alias("overlap")).join(size.hint("merge"), ["unit", "segment", "template"])
    ok = over.where(F.col("overlap") >= F.greatest(F.lit(3.0), 0.3 * F.col("len")))
    return ok.withColumn("_r", F.row_number().over(W.partitionBy("unit", "segment").orderBy("rank", F.desc("overlap"), "start"))).where("_r = 1").select("unit", "segment", "template", "start", "end", "overlap")


def template_from_landmarks(run: DataFrame, landmarks: DataFrame, unit: str, candidate: str, most: int = 2, new: int = 5) -> DataFrame:
    """run (unit, candidate, priority, start, end), landmarks (segment, position): segments of the primary candidate, then
    of up to ``most`` complementary ones that resolve a missing landmark and add more than ``new`` positions.

    The choice is greedy over the few candidates of one unit, so it runs in pandas by unit."""
    import pandas as pd

    hit = run.join(F.broadcast(landmarks), F.col("position").between(F.col("start"), F.col("end")))  # landmarks are a fixed list

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        out, covered, found, used = [], set(), set(), 0
        for (_, cand), g in pdf.sort_values(["priority", candidate, "start", "segment"]).groupby(["priority", candidate], sort=True):
            mine = {p for r in g.itertuples() for p in range(r.start, r.end + 1)}
            fresh = set(g["segment"]) - found
            if out and (not fresh or len(mine - covered) <= new or used >= most):
                continue
            used += bool(out)
            for r in g.itertuples():
                if r.segment not in found:
                    out.append((r.__getattribute__(unit), cand, r.segment, r.start, r.end))
                    found.add(r.segment)
            covered |= mine
        return pd.DataFrame(out, columns=["unit", "candidate", "segment", "start", "end"])

    return hit.groupBy(unit).applyInPandas(choose, "unit long, candidate long, segment string, start long, end long")


def enforce_order(blocks: DataFrame, order: Sequence[str]) -> DataFrame:
    """blocks (unit, segment, start, confidence): kept by (confidence, order) unless they break the canonical order
    against the blocks kept before. A unit has at most one block a segment, so it runs in pandas by unit."""
    import pandas as pd

    rank = {s: i for i, s in enumerate(order)}
    level = {c: i for i, c in enumerate(CONFIDENCE)}

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[int, int]] = []
        flags = {}
        for r in sorted(pdf.itertuples(), key=lambda r: (level.get(r.confidence, 9), rank[r.segment])):
            o, at = rank[r.segment], int(r.start)
            flags[r.Index] = all((o - p) * (at - q) > 0 for p, q in kept)
            if flags[r.Index]:
                kept.append((o, at))
        return pdf.assign(kept=[flags[i] for i in pdf.index])

    return blocks.select("unit", "segment", F.col("start").cast("long").alias("start"), "confidence").groupBy("unit").applyInPandas(keep, "unit int, segment string, start long, confidence string, kept boolean")


def segment_map(bounds: DataFrame, blocks: DataFrame, unit: str = "unit") -> DataFrame:
    """One row a position: the block's name, else the loop between its neighbours or LOOP_UNCERTAIN, NO_EVIDENCE for units
    without a block."""
    g = dense_grid(bounds, [unit], F.col("lo"), F.col("hi"))
    b = blocks.withColumn("position", F.explode(F.sequence("start", "end"))).groupBy(unit, "position").agg(F.min("segment").alias("call"))
    d = bracketing_neighbours(g.join(b.hint("merge"), [unit, "position"], "left"), [unit], "position", "call")
    return d.withColumn("name", F.when(F.col("reason") == "NO_CALLS", "NO_EVIDENCE").otherwise(F.col("name")))


def missing_segment_audit(units: DataFrame, expected: Sequence[str], placed: DataFrame, offered: DataFrame, evidence: DataFrame) -> DataFrame:
    """Why a unit lacks a segment: A no evidence for the unit, D no template offers it, C alignment failed."""
    all_pairs = units.select("unit").distinct().withColumn("segment", F.explode(F.array(*(F.lit(s) for s in expected))))
    gap = all_pairs.join(placed.select("unit", "segment").hint("merge"), ["unit", "segment"], "left_anti")
    j = gap.join(evidence.select("unit").distinct().withColumn("_e", F.lit(1)).hint("merge"), "unit", "left").join(offered.select("segment").distinct().withColumn("_o", F.lit(1)).hint("merge"), "segment", "left")
    return j.select("unit", "segment", F.when(F.col("_e").isNull(), "A_NO_EVIDENCE").when(F.col("_o").isNull(), "D_NO_TEMPLATE").otherwise("C_ALIGNMENT_FAILED").alias("cause"))


def segment_validation(blocks: DataFrame, calls: DataFrame, unit: str = "unit") -> DataFrame:
    """Start, end, length, and the share of positions whose call agrees with the block's class."""
    p = blocks.withColumn("position", F.explode(F.sequence("start", "end"))).join(calls.hint("merge"), [unit, "position"], "left")
    return p.groupBy(unit, "segment", "start", "end").agg(F.count("state").alias("n_called"), F.avg((F.coalesce("state", F.lit("")) == F.col("cls")).cast("int")).alias("agreement")).withColumn("length", F.col("end") - F.col("start") + 1)


def site_definitions(segment_rows: DataFrame, contacts: DataFrame, curated: DataFrame, site_segments: Mapping[str, str], contact_site: str, least: float = 0.25) -> DataFrame:
    """(unit, site, position, level): curated positions first, contact consensus of ``least`` for the contact site, whole
    segments only for units without curated positions of that site."""
    names = F.create_map(*(F.lit(x) for p in site_segments.items() for x in p))
    whole = segment_rows.withColumn("site", F.try_element_at(names, "segment")).where("site is not null")
    whole = whole.join(curated.select("unit", "site").distinct().hint("merge"), ["unit", "site"], "left_anti").select("unit", "site", "position", F.lit("SEGMENT").alias("level"))
    touch = contacts.where(F.col("fraction") >= least).select("unit", F.lit(contact_site).alias("site"), "position", F.lit("CONTACT").alias("level"))
    return curated.select("unit", "site", "position", F.lit("RESIDUE").alias("level")).unionByName(touch).unionByName(whole)


def entry_site_scores(prof: DataFrame, sites: DataFrame, background: DataFrame | None = None, least_background: int = 1) -> DataFrame:
    """Median and mean z of each entry's site positions against its background: all other observed positions, or those of
    ``background`` (unit, site, position). Rows without site or with too little background are dropped."""
    s = sites.groupBy("unit", "site").agg(F.collect_set("position").alias("_in"))
    if background is not None:
        s = s.join(background.groupBy("unit", "site").agg(F.collect_set("position").alias("_bg")).hint("merge"), ["unit", "site"])
    j = prof.join(s.hint("merge"), "unit")
    inside = F.array_contains("_in", F.col("position"))
    outside = ~inside if background is None else F.array_contains("_bg", F.col("position"))
    g = j.groupBy("unit", "entry", "site").agg(
        F.count(F.when(inside, 1)).alias("n_site"), F.count(F.when(outside, 1)).alias("n_background"), F.median(F.when(inside, F.col("z"))).alias("site_median"), F.avg(F.when(inside, F.col("z"))).alias("site_mean"),
        F.median(F.when(outside, F.col("z"))).alias("background_median"), F.max(F.size("_in")).alias("_size"),
    ).where((F.col("n_site") > 0) & (F.col("n_background") >= least_background))
    return g.withColumns({"delta": F.col("site_median") - F.col("background_median"), "coverage": F.col("n_site") / F.col("_size")}).drop("_size")


def unit_site_summary(scores: DataFrame, replicates: int = 2000) -> DataFrame:
    """Median delta over entries with quartiles and bootstrap interval, and coverage, by unit and site."""
    q = F.percentile("delta", F.array(F.lit(0.25), F.lit(0.75)))
    g = scores.groupBy("unit", "site").agg(F.count(F.lit(1)).alias("n_entries"), F.median("delta").alias("median_delta"), q.alias("_q"), F.avg("coverage").alias("coverage"))
    g = g.withColumn("iqr", F.col("_q")[1] - F.col("_q")[0]).drop("_q")
    return g.join(bootstrap_ci(scores, ["unit", "site"], "delta", replicates), ["unit", "site"])


#: Positions of a map that are sent to sites without other controls at once; a longer map goes by shuffled slices of it.
SLICE_POSITIONS = 100_000


def matched_controls(sites: DataFrame, segmap: DataFrame, least: int = 5) -> DataFrame:
    """(unit, site, position, tier): other positions of the site's segments if there are ``least``, else of its classes,
    else all named positions (named_only). segmap (position, segment, cls)."""
    here = sites.join(segmap.hint("merge"), "position").select("unit", "site", "position", "segment", "cls")

    def of_same(column: str) -> DataFrame:
        named = here.select("unit", "site", column).distinct().join(segmap.select("position", column).hint("merge"), column).select("unit", "site", "position").distinct()
        return named.join(here.select("unit", "site", "position"), ["unit", "site", "position"], "left_anti")

    def enough(rows: DataFrame) -> DataFrame:
        return rows.groupBy("unit", "site").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("unit", "site")

    first, second = of_same("segment"), of_same("cls")
    in_first = enough(first)
    in_second = enough(second).join(in_first, ["unit", "site"], "left_anti")
    rest = here.select("unit", "site").distinct().join(in_first, ["unit", "site"], "left_anti").join(in_second, ["unit", "site"], "left_anti")
    names = staged(segmap.select("position").distinct(), "named-positions")
    n = max(1, -(-names.count() // SLICE_POSITIONS))
    names = names.withColumn("_slice", F.pmod(F.xxhash64("position"), F.lit(n)))
    each = rest.withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    third = each.join(F.broadcast(names) if n == 1 else names.hint("merge"), "_slice").drop("_slice").join(here.select("unit", "site", "position"), ["unit", "site", "position"], "left_anti")
    parts = [(first.join(in_first, ["unit", "site"], "left_semi"), "same_segment"), (second.join(in_second, ["unit", "site"], "left_semi"), "same_class"), (third, "named_only")]
    out = [p.select("unit", "site", "position", F.lit(tier).alias("tier")) for p, tier in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def confirmatory_reanalysis(summaries: DataFrame, confident: DataFrame) -> DataFrame:
    """Site-class tests of unit deltas against 0 on the confident definitions only, with q over the sites."""
    good = summaries.join(confident.select("unit", "site").distinct(), ["unit", "site"], "left_semi")
    return bh_fdr(wilcoxon_one_sample(good, ["site"], "median_delta"), "p", [], ["site"])


def atlas(unitseg: DataFrame, replicates: int = 2000) -> DataFrame:
    """Per segment: n, median, mean, quartiles, interval, shares above and below 0, ranks, and top and bottom flags."""
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.75)))
    g = unitseg.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.median("v").alias("median"), F.avg("v").alias("mean"), q.alias("_q"), F.avg((F.col("v") > 0).cast("int")).alias("share_up"), F.avg((F.col("v") < 0).cast("int")).alias("share_down"))
    g = g.withColumns({"q25": F.col("_q")[0], "q75": F.col("_q")[1], "_all": F.lit(1)}).drop("_q").join(bootstrap_ci(unitseg, ["segment"], "v", replicates), "segment")
    return top_bottom_share(rank_min_desc(g, ["_all"], "median"), ["_all"], "median", "segment", least=1).drop("_all")


def omnibus(long: DataFrame, schemes: Mapping[str, str], test: str, v: str) -> DataFrame:
    """The omnibus test under several grouping schemes, with q inside each scheme."""
    out = None
    for name, column in schemes.items():
        k = kruskal(long, [test], column, v).withColumn("scheme", F.lit(name))
        out = k if out is None else out.unionByName(k)
    return bh_fdr(out, "p", ["scheme"], [test])


def position_comparison(prof: DataFrame, value: str, first: str = "HOLO", second: str = "APO", conflict: str | None = None) -> DataFrame:
    """The two-state test at every (unit, position) of the entries' profiles (unit, entry, position, state), with q within the unit and over all.

    Entries of any other state, as those whose instances disagree, take no part, nor do those whose column ``conflict`` is true.
    Positions without enough entries of both states have no row."""
    rows = prof if conflict is None else prof.where(~F.coalesce(F.col(conflict), F.lit(False)))
    tests = mann_whitney(rows, ["unit", "position"], "state", value, first, second)
    return bh_fdr(bh_fdr(tests, "p", ["unit"], ["position"]), "p", [], ["unit", "position"], "q_global")


def curated_site_scores(prof: DataFrame, sites: DataFrame) -> DataFrame:
    """(unit, site, score, n_entries): medians of the means of entries over a site's positions; an entry counts only if every position of the
    site is there; sites without any stay. prof: (unit, entry, position, z), one row each. sites (unit, site, position) are few and sent to
    the tasks, so rows that lie together by entry stay where they are."""
    size = sites.groupBy("unit", "site").agg(F.count_distinct("position").alias("size"))
    here = sites.join(size, ["unit", "site"])
    got = prof.where("z is not null").join(F.broadcast(here), ["unit", "position"]).groupBy("unit", "entry", "site", "size").agg(F.avg("z").alias("m"), F.count(F.lit(1)).alias("n"))
    full = quantiles(got.where("n = size").select("unit", "site", "m"), ["unit", "site"], "m", (0.5,))
    full = full.select("unit", "site", F.col("q")[0].alias("score"), F.col("n").alias("n_entries"))
    return size.join(full.hint("merge"), ["unit", "site"], "left").fillna(0, ["n_entries"]).drop("size")


def ligand_states(points: DataFrame, probes: DataFrame, group: str, point_id: str, probe_id: str, kind, r: float) -> DataFrame:
    """Contacts within r, the kind of each contacted probe by evidence rules, and the state of each point."""
    near = radius_contacts(points, probes, group, point_id, probe_id, r).join(probes.select(F.col(group), F.col(probe_id).alias("probe"), kind.alias("kind")).hint("merge"), [group, "probe"])
    seen = points.select(F.col(group), F.col(point_id).alias("point")).join(near.hint("merge"), [group, "point"], "left")
    return state_from_evidence(seen, [group, "point"], F.lit(True), F.col("kind") == "FUNCTIONAL", F.col("kind") == "UNRESOLVED")


def partner_states(
    points: DataFrame, partners: DataFrame, described: DataFrame, entry: str, position: str, partner: str, occupancy: str, r: float,
    text: str, length: str, keywords: Mapping[str, Sequence[str]], max_length: int, known: Column, known_label: str,
) -> DataFrame:
    """(entry, partner, min_distance, positions, category) of the partners that touch an entry's points within r: the positions that they
    touch, and a class by what is known of them or by keywords of their description. Atoms without occupancy do not count, nor do
    partners without others. described (partner, text, length, and what ``known`` needs); partners without a row there are classed
    by an empty text."""
    near = probe_contacts(points, partners, entry, position, partner, occupancy, r, r, inventory=False).where("within_near")
    named = described.select(F.col(partner).alias("_p"), F.coalesce(keyword_class(F.col(text), F.col(length), keywords, max_length, known, known_label)).alias("category"))
    return near.join(named.hint("merge"), F.col("probe") == F.col("_p"), "left").select(entry, F.col("probe").alias(partner), "min_distance", "positions", F.coalesce("category", F.lit("OTHER")).alias("category"))


def interpretation_table(tests: DataFrame, sites: DataFrame, names: Mapping[str, str], prefixes: Mapping[str, str]) -> DataFrame:
    """tests (unit, segment, position, ...): category of the segment and nearest site position."""
    near = nearest_within(tests, sites, ["unit"], "position", "site_position")
    return near.withColumn("category", segment_category(F.col("segment"), names, prefixes, "OTHER"))


def flags_low_quality(df: DataFrame) -> DataFrame:
    return df.withColumns({"low_confidence": F.col("confidence") == "LOW", "low_coverage": F.col("coverage") < 0.5, "segment_only": F.col("level") == "SEGMENT"})


