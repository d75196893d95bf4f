"""SQL of tail probabilities and of q, from the definitions: rank tests are counted exactly or use a series of erfc."""


def erfc(x: str) -> str:
    """The complementary error function of a non-negative column, by the series of erf."""
    return f"(CASE WHEN {x} <= 0 THEN 1.0 WHEN {x} > 6 THEN 0.0 ELSE 1 - list_sum(list_transform(range(0, 200), lambda i: exp((2 * i + 1) * ln({x}) - lgamma(i + 1.5) - {x} * {x}))) END)"


def mann_whitney(src: str, t: str = "unit, segment", a: str = "HOLO", b: str = "APO", least: int = 3) -> str:
    """(t, n1, n2, u, delta, median_delta, tier, p) of the tests of ``src`` (t, s, v)."""
    on = " AND ".join(f"e.{k.strip()} IS NOT DISTINCT FROM w.{k.strip()}" for k in t.split(","))
    keys = ", ".join(f"w.{k.strip()}" for k in t.split(","))
    return f"""(WITH RECURSIVE f AS (SELECT * FROM {src} WHERE s IN ('{a}', '{b}') AND v IS NOT NULL),
  r AS (SELECT *, rank() OVER (PARTITION BY {t} ORDER BY v) + (count(*) OVER (PARTITION BY {t}, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY {t}, v) AS tie FROM f),
  g AS (SELECT {t}, count(*) FILTER (s = '{a}') AS n1, count(*) FILTER (s = '{b}') AS n2, sum(r) FILTER (s = '{a}') AS rs, median(v) FILTER (s = '{a}') AS m1, median(v) FILTER (s = '{b}') AS m2, sum(tie * tie - 1)::DOUBLE AS ties FROM r GROUP BY {t}),
  w AS (SELECT *, rs - n1 * (n1 + 1) / 2.0 AS u, greatest(rs - n1 * (n1 + 1) / 2.0, n1 * n2 - rs + n1 * (n1 + 1) / 2.0) AS big, least(n1, n2) <= 8 AND ties = 0 AS exact FROM g WHERE least(n1, n2) >= {least}),
  x AS (SELECT *, greatest(0, (big - n1 * n2 / 2.0 - 0.5) / sqrt(nullif(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0))), 0)) / sqrt(2)) AS z FROM w),
  k(r, m, s, c) AS (SELECT 0, 0, 0, 1::DOUBLE UNION ALL (SELECT r + 1, m + d, s + d * (r + 1), sum(c) FROM k, (VALUES (0), (1)) AS o(d) WHERE r < (SELECT coalesce(max(n1 + n2), 0) FROM w WHERE exact) AND m + d <= 8 GROUP BY r, m + d, s + d * (r + 1))),
  e AS (SELECT {keys}, least(1, 2 * sum(c) FILTER (k.s - k.m * (k.m + 1) / 2 >= round(big)) / sum(c)) AS p FROM w JOIN k ON k.r = n1 + n2 AND k.m = least(n1, n2) WHERE exact GROUP BY ALL)
  SELECT {keys}, n1, n2, u, 2 * u / (n1 * n2) - 1 AS delta, m1 - m2 AS median_delta, CASE WHEN least(n1, n2) >= 5 THEN 'PRIMARY' ELSE 'EXPLORATORY' END AS tier,
    coalesce(e.p, least(1, CASE WHEN w.z IS NULL THEN 1 ELSE {erfc('w.z')} END)) AS p FROM x AS w LEFT JOIN e ON {on})"""


def signed_rank(src: str, t: str) -> str:
    """(t, n_pairs, n, w_plus, rank_biserial, p) of the differences d of ``src``, tests without a difference left out."""
    on = " AND ".join(f"e.{k.strip()} = w.{k.strip()}" for k in t.split(","))
    keys = ", ".join(f"w.{k.strip()}" for k in t.split(","))
    return f"""(WITH RECURSIVE f AS (SELECT * FROM {src} WHERE d IS NOT NULL),
  r AS (SELECT *, rank() OVER (PARTITION BY {t} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {t}, abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY {t}, abs(d)) AS tie FROM f WHERE d <> 0),
  g AS (SELECT {t}, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(r) AS total, sum(tie * tie - 1)::DOUBLE AS ties FROM r GROUP BY {t}),
  w AS (SELECT g.*, n_pairs, n <= 50 AND n_pairs = n AND ties = 0 AS exact FROM g JOIN (SELECT {t}, count(*) AS n_pairs FROM f GROUP BY {t}) USING ({t})),
  x AS (SELECT *, abs(w_plus - n * (n + 1) / 4.0) / sqrt(nullif((n * (n + 1) * (2 * n + 1.0) - ties / 2) / 24, 0)) / sqrt(2) AS z FROM w),
  k(r, s, c) AS (SELECT 0, 0, 1::DOUBLE UNION ALL (SELECT r + 1, s + d * (r + 1), sum(c) FROM k, (VALUES (0), (1)) AS o(d) WHERE r < (SELECT coalesce(max(n), 0) FROM w WHERE exact) GROUP BY r, s + d * (r + 1))),
  e AS (SELECT {keys}, least(1, 2 * least(sum(c) FILTER (k.s <= round(w_plus)), sum(c) FILTER (k.s >= round(w_plus))) / sum(c)) AS p FROM w JOIN k ON k.r = w.n WHERE exact GROUP BY ALL)
  SELECT {keys}, n_pairs, n, w_plus, (2 * w_plus - total) / total AS rank_biserial, coalesce(e.p, CASE WHEN w.z IS NULL THEN 1 ELSE {erfc('w.z')} END) AS p FROM x AS w LEFT JOIN e ON {on})"""


def q(p: str, family: str, key: str) -> str:
    """Benjamini-Hochberg inside a query over rows (p, family, key)."""
    part = f"PARTITION BY {family}" if family else ""
    return f"least(1, min({p} * n_family / nth) OVER ({part} ORDER BY nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


def with_q(src: str, family: str, key: str, out: str = "q", p: str = "p") -> str:
    part = f"PARTITION BY {family}" if family else ""
    return f"(SELECT * EXCLUDE (nth, n_family), {q(p, family, key)} AS {out} FROM (SELECT *, row_number() OVER ({part} ORDER BY {p}, {key}) AS nth, count(*) OVER ({part}) AS n_family FROM {src}))"


def chi2_tail_even(h: str, df: int) -> str:
    """Tail of chi-square with an even number of degrees of freedom: a finite sum."""
    terms = " + ".join(f"power({h} / 2, {i}) / {'*'.join(map(str, range(1, i + 1))) or '1'}" for i in range(df // 2))
    return f"exp(-{h} / 2) * ({terms})"
