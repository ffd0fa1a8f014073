"""SQL of the bootstrap and of the random-intercept model, as common table expressions for the queries' oracles."""

from __future__ import annotations


def bootstrap_sql(source: str, name: str = "ci", reps: int = 2000, seed: int = 1729) -> str:
    """``name`` (id, n, median_diff, ci_lo, ci_hi) from ``source`` (id, d)."""
    return f"""
{name}_v AS (SELECT id, coalesce(list_sort(list(d) FILTER (d IS NOT NULL AND isfinite(d))), []) AS v FROM {source} GROUP BY id),
{name}_x AS (SELECT id, r, v[1 + ((('0x' || left(md5('{seed}|' || r || '|' || j), 8))::BIGINT * len(v)) >> 32)] AS x FROM {name}_v, range(1, {reps + 1}) a(r), LATERAL (SELECT unnest(range(1, len(v) + 1)) AS j) WHERE len(v) >= 2),
{name}_m AS (SELECT id, r, median(x) AS m FROM {name}_x GROUP BY id, r),
{name}_q AS (SELECT id, quantile_cont(m, 0.025) AS ci_lo, quantile_cont(m, 0.975) AS ci_hi FROM {name}_m GROUP BY id),
{name} AS (SELECT id, len(v) AS n, list_median(v) AS median_diff, ci_lo, ci_hi FROM {name}_v LEFT JOIN {name}_q USING (id))"""


_TERM = "exp(lgamma(i + 0.5) - lgamma(0.5) - lgamma(i + 1))"
_EVEN = f"sqrt(1 - c2) * list_sum(list_transform(range(0, (df - 2) // 2 + 1), lambda i: {_TERM} * c2 ** i))"
_ODD = "2 / pi() * (acos(sqrt(c2)) + sqrt(1 - c2) * sqrt(c2) * coalesce(list_sum(list_transform(range(0, (df - 3) // 2 + 1), lambda i: exp(lgamma(1.5) + lgamma(i + 1) - lgamma(i + 1.5)) * c2 ** i)), 0))"
_TAIL = f"exp(df / 2 * ln(c2) - lgamma(df / 2) - lgamma(0.5) + lgamma(df / 2 + 0.5)) * list_sum(list_transform(range(0, 90), lambda i: {_TERM} * c2 ** i / (df / 2 + i)))"


def mixed_sql(source: str, terms: int) -> str:
    """``source``_fit (id, n, estimate, p_value): the last of x1 ... in y ~ 1 + x1 + ... + (1 | g) of ``source`` (id, g, y, x1, ...)."""
    k = terms + 1
    cols = ["1.0::DOUBLE", *[f"x{i}" for i in range(1, k)], "y"]
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    s = source
    out = [
        f"{s}_g AS (SELECT id, g, " + ", ".join(f"sum({c}) AS s{i}" for i, c in enumerate(cols)) + ", " + ", ".join(f"sum({cols[i]} * {cols[j]}) AS p{i}{j}" for i, j in pairs) + f" FROM {s} WHERE y IS NOT NULL AND isfinite(y) GROUP BY id, g)",
        f"{s}_r AS (SELECT 0.0::DOUBLE AS ratio UNION ALL SELECT 10.0::DOUBLE ** (k / 20.0::DOUBLE) FROM range(-80, 81) t(k))",
        f"{s}_0 AS (SELECT id, ratio, sum(s0)::BIGINT AS n, count(*) AS ng, sum(ln(1 + ratio * s0)) AS spread, 0.0::DOUBLE AS ld, " + ", ".join(f"sum(p{i}{j} - ratio / (1 + ratio * s0) * s{i} * s{j}) AS m{i}{j}" for i, j in pairs) + f" FROM {s}_g, {s}_r GROUP BY id, ratio)",
    ]
    for p in range(k):
        piv = f"nullif(greatest(m{p}{p}, 1e-10), 1e-10)"
        last = f", m{p}{k} / {piv} AS slope, {piv} AS diag" if p == k - 1 else ""
        out.append(f"{s}_{p + 1} AS (SELECT id, ratio, n, ng, spread, ld + ln({piv}) AS ld{last}, " + ", ".join(f"m{i}{j} - m{p}{i} * m{p}{j} / {piv} AS m{i}{j}" for i, j in pairs if i > p) + f" FROM {s}_{p})")
    out += [
        f"{s}_c AS (SELECT *, greatest(m{k}{k}, 0) / nullif(n - {k}, 0) AS s2 FROM {s}_{k} WHERE n > {k})",
        f"{s}_b AS (SELECT * FROM {s}_c WHERE ld IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY round((n - {k}) * ln(greatest(s2, 1e-300)) + spread + ld, 8), ratio) = 1)",
        f"{s}_t AS (SELECT id, slope, (n - ng - {k - 1})::DOUBLE AS df, (n - ng - {k - 1}) / (n - ng - {k - 1} + slope * slope * diag / nullif(s2, 0)) AS c2 FROM {s}_b WHERE n - ng - {k - 1} >= 1)",
        f"{s}_p AS (SELECT id, slope, CASE WHEN c2 IS NULL THEN 0 WHEN c2 < 0.5 THEN {_TAIL} WHEN df % 2 = 0 THEN greatest(0, 1 - ({_EVEN})) ELSE greatest(0, 1 - ({_ODD})) END AS p FROM (SELECT id, slope, df::BIGINT AS df, c2 FROM {s}_t))".replace("df / 2", "df / 2.0::DOUBLE"),
        f"{s}_fit AS (SELECT a.id, coalesce(n, 0)::BIGINT AS n, slope AS estimate, p AS p_value FROM (SELECT DISTINCT id FROM {s}) a LEFT JOIN (SELECT id, sum(s0) AS n FROM {s}_g GROUP BY id) b USING (id) LEFT JOIN {s}_p USING (id))",
    ]
    return ",\n".join(out)
