"""Conditional classification: statuses, bins, flags and reasons as column expressions.

Missing input is never turned into a verdict: statuses say MISSING or REVIEW_NEEDED, flags are null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _none(arr: Column) -> Column:
    return arr.isNull() | (F.size(arr) <= 0)


def range_status(arr: Column, lo: float, hi: float) -> Column:
    """One reading: BELOW, ABOVE or PASS (bounds count as inside); MISSING without, MULTI_VALUE_REVIEW with several."""
    x = F.get(arr, F.lit(0))
    return F.when(_none(arr), "MISSING").when(F.size(arr) > 1, "MULTI_VALUE_REVIEW").when(x < lo, "BELOW").when(x > hi, "ABOVE").otherwise("PASS")


def all_le_status(arr: Column, cap: float) -> Column:
    return F.when(_none(arr), "MISSING").when(F.forall(arr, lambda x: x <= cap), "PASS_ALL").when(F.forall(arr, lambda x: x > cap), "FAIL_ALL").otherwise("MIXED")


def bin_by_edges(x: Column, edges: Sequence[float], labels: Sequence[str], right: bool = False, exact_top: str | None = None) -> Column:
    """labels[i] for edges[i] <= x < edges[i + 1] (right: edges[i] < x <= edges[i + 1]); null outside.

    exact_top: a bin of its own for x equal to the last edge.
    """
    out = F.when(x == edges[-1], exact_top) if exact_top else F.when(F.lit(False), "")
    for lo, hi, label in zip(edges, edges[1:], labels, strict=False):
        out = out.when((x > lo) & (x <= hi) if right else (x >= lo) & (x < hi), label)
    return out


def threshold_flags(x: Column, levels: Sequence[float], name: str = "ge") -> list[Column]:
    """One boolean a level; null stays null (not assessable)."""
    return [(x >= F.lit(t)).alias(f"{name}_{round(t * 100):03d}") for t in levels]


def reason_codes(rules: Mapping[str, Column]) -> Column:
    """Names of all failing rules, in order; a rule that is null fails nothing."""
    return F.array_compact(F.array(*(F.when(fails, F.lit(name)) for name, fails in rules.items())))


def selection_status(reasons: Column, present: Column) -> Column:
    return F.when(~present, "NO_CANDIDATE").when(F.size(reasons) == 0, "SELECTED").otherwise("EXCLUDED")


def reason_counts(df: DataFrame, reasons: str) -> DataFrame:
    return df.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def select_pool(first: Column, second: Column, names: tuple[str, str] = ("FIRST", "SECOND")) -> Column:
    """SELECTED, or which of two conditions fails; null fails."""
    a, b = F.coalesce(first, F.lit(False)), F.coalesce(second, F.lit(False))
    return F.when(a & b, "SELECTED").when(a, f"NOT_{names[1]}").when(b, f"NOT_{names[0]}").otherwise("NEITHER")


def sensitivity_views(df: DataFrame, views: Mapping[str, Column]) -> DataFrame:
    """Membership of alternative cohorts as boolean columns; no row is dropped."""
    return df.withColumns({name: F.coalesce(rule, F.lit(False)) for name, rule in views.items()})


def override_lookup(df: DataFrame, overrides: DataFrame, key: str, default: Column, exception: Column, out: str) -> DataFrame:
    """``default``, or for exceptions the ``out`` column of the override table, which must have them (else it fails)."""
    o = overrides.select(F.col(key).alias("_k"), F.col(out).alias("_o"))
    j = df.join(o, F.col(key) == F.col("_k"), "left")
    found = F.when(F.assert_true(~exception | F.col("_o").isNotNull(), F.concat(F.lit("no override for "), F.col(key).cast("string"))).isNull(), F.when(exception, F.col("_o")).otherwise(default))
    return j.withColumn(out, found).drop("_k", "_o")


def evidence_cascade(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """Label of the first rule that holds."""
    out = F.when(F.lit(False), "")
    for rule, label in rules:
        out = out.when(rule, label)
    return out.otherwise(otherwise)


def state_from_evidence(df: DataFrame, keys: list[str], observed: Column, functional: Column, unresolved: Column) -> DataFrame:
    """No observed point: AMBIGUOUS; any functional: HOLO; any unresolved contact: AMBIGUOUS; else APO."""
    any_of = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    g = df.groupBy(*keys).agg(any_of(observed).alias("o"), any_of(observed & functional).alias("f"), any_of(observed & unresolved).alias("u"))
    return g.select(*keys, F.when(~F.col("o"), "AMBIGUOUS").when(F.col("f"), "HOLO").when(F.col("u"), "AMBIGUOUS").otherwise("APO").alias("state"))


def keyword_class(text: Column, length: Column, keywords: Mapping[str, Sequence[str]], max_length: int, known: Column, known_label: str) -> Column:
    """Known ids first; then the first class with a keyword in the lower-cased text, if it is short enough."""
    out, low = F.when(known, known_label), F.lower(F.coalesce(text, F.lit("")))
    for label, words in keywords.items():
        hit = F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(low, w))
        out = out.when(hit & (length <= max_length), label)
    return out.otherwise("OTHER")


def validate_records(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """One boolean a check (null counts as failed) and ``valid``."""
    df = df.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in checks.items()})
    return df.withColumn("valid", F.forall(F.array(*checks), lambda x: x))


def audit_status(hard: Column, soft: Mapping[str, Column]) -> tuple[Column, Column]:
    """(status, reasons): FAIL on hard, REVIEW_NEEDED with reasons on any soft, else PASS."""
    reasons = F.concat_ws(";", reason_codes(soft))
    return F.when(hard, "FAIL").when(reasons != "", "REVIEW_NEEDED").otherwise("PASS"), reasons


def provenance_class(source: Column, host: Column) -> Column:
    """Two sets of names: SAME; DIFFERENT_EXPLAINED if one holds the other; else REVIEW_NEEDED, also if one is missing."""
    s, h = F.array_sort(F.array_distinct(source)), F.array_sort(F.array_distinct(host))
    part = (F.size(F.array_except(s, h)) == 0) | (F.size(F.array_except(h, s)) == 0)
    return F.when(_none(source) | _none(host), "REVIEW_NEEDED").when(s == h, "SAME").when(part, "DIFFERENT_EXPLAINED").otherwise("REVIEW_NEEDED")


def scope_class(rules: Sequence[tuple[str, Column]]) -> Column:
    """Why a record is out of scope: the first reason that holds, else IN_SCOPE."""
    return evidence_cascade([(c, n) for n, c in rules], "IN_SCOPE")


def tolerance_status(a: Column, b: Column, near: float = 1e-4, far: float = 1e-2) -> Column:
    d = F.abs(a - b)
    return F.when(d <= near, "MATCH").when(d <= far, "MINOR").otherwise("REVIEW_NEEDED")


def boundary_diff_class(s1: Column, e1: Column, s2: Column, e2: Column, minor: int = 2) -> Column:
    gone = s1.isNull() | e1.isNull() | s2.isNull() | e2.isNull()
    d = F.greatest(F.abs(s1 - s2), F.abs(e1 - e2))
    return F.when(gone, "UNAVAILABLE").when(d == 0, "MATCH").when(d <= minor, "MINOR").otherwise("MATERIAL")


def attrition_cause(construct_gap: Column, coordinate_gap: Column, length: Column, share: float = 0.2) -> Column:
    """Which gap is larger; BOTH if they differ by no more than max(1, share x length)."""
    return F.when(F.abs(construct_gap - coordinate_gap) <= F.greatest(F.lit(1.0), share * length), "BOTH").when(construct_gap > coordinate_gap, "CONSTRUCT_GAP").otherwise("COORDINATE_GAP")


def definition_tier(level: Column, confidence: Column) -> Column:
    """A: position-level and HIGH; B: position-level or at least MODERATE; C: the rest."""
    fine, high = level == "RESIDUE", confidence == "HIGH"
    return F.when(fine & high, "A").when(fine | high | (confidence == "MODERATE"), "B").otherwise("C")


def segment_category(segment: Column, names: Mapping[str, str], prefixes: Mapping[str, str], otherwise: str) -> Column:
    """By exact name, else by the first prefix that fits."""
    known = F.try_element_at(F.create_map(*(F.lit(x) for p in names.items() for x in p)), segment)
    return F.coalesce(known, evidence_cascade([(segment.startswith(p), label) for p, label in prefixes.items()], otherwise))


def method_flags(arr: Column, known: Sequence[str]) -> dict[str, Column]:
    """has_<token> for each known token, has_other for any token not known."""
    flags = {f"has_{k}": F.arrays_overlap(arr, F.array(F.lit(k))) for k in known}
    return flags | {"has_other": F.size(F.array_except(arr, F.array(*(F.lit(k) for k in known)))) > 0}


def mapping_status(key: Column, ids: Column) -> Column:
    inside = F.coalesce(F.array_contains(ids, key), F.lit(False))
    return F.when(inside & (F.size(ids) == 1), "CONFIRMED").when(inside, "CONFIRMED_MULTI").otherwise("REVIEW")


def within_reference(s: Column, e: Column, ref_s: Column, ref_e: Column) -> Column:
    return F.when(ref_s.isNull() | ref_e.isNull(), "UNKNOWN").when((s >= ref_s) & (e <= ref_e), "WITHIN").otherwise("EXTENDS_OUTSIDE")
