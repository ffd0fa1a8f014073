"""Linear models with a random intercept a group, fitted from the sums of each group.

Rows are aggregated once to sums and sums of products by group. The profiled REML criterion is a table over a
grid of variance ratios: what a ratio takes from the products is again a sum over groups, and the equations are
solved by elimination in columns, so that neither rows nor groups reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import is_finite

#: Variance ratios (between groups to within) at which the criterion is evaluated: none, and 20 a decade.
RATIOS = (0.0, *[10 ** (k / 20) for k in range(-80, 81)])


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > |t|) for whole degrees of freedom; null below one, 0 for an infinite ``t``.

    Near the middle it is the finite series in the angle, absolute error near 1e-15; in the tails the series of the
    incomplete beta function, whose terms are all positive, so that small values keep their digits.
    """
    df, odd = df.cast("long"), df.cast("long") % 2
    angle = F.atan(F.abs(t) / F.sqrt(df))
    c2, s, c = df / (df + t * t), F.sin(angle), F.cos(angle)
    upto = lambda n: F.when(n >= 1, F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    pair = lambda term, total: F.struct(term.alias("term"), total.alias("total"))

    # Terms grow by 2i / (2i + 1) for odd and (2i - 1) / (2i) for even degrees of freedom, each times cos^2.
    def next_angle(a: Column, i: Column) -> Column:
        term = a["term"] * c2 * (2 * i - 1 + odd) / (2 * i + odd)
        return pair(term, a["total"] + term)

    series = F.aggregate(upto(F.floor((df - 2 - odd) / 2)), pair(F.lit(1.0), F.lit(1.0)), next_angle)["total"]
    inside = F.when(odd == 0, s * series).when(df == 1, 2 * angle / F.pi()).otherwise(2 / F.pi() * (angle + s * c * series))

    half = df / 2

    def next_tail(a: Column, i: Column) -> Column:
        term = a["term"] * c2 * (i - 0.5) / i
        return pair(term, a["total"] + term / (half + i))

    tail = F.aggregate(upto(F.lit(80)), pair(F.lit(1.0), 1 / half), next_tail)["total"]  # c2 < 1/2: 80 terms reach 1e-24
    # B(df/2, 1/2) from B(1/2, 1/2) = pi or B(1, 1/2) = 2, a whole step at a time.
    beta = F.aggregate(upto(F.floor((df - 1) / 2)), F.when(odd == 1, F.pi()).otherwise(F.lit(2.0)), lambda z, i: z * (2 * i - odd) / (2 * i - odd + 1))
    p = F.when(c2 < 0.5, F.exp(half * F.ln(c2)) * tail / beta).otherwise(F.greatest(F.lit(0.0), 1 - inside))
    return F.when(df >= 1, F.when(F.abs(t) == float("inf"), F.lit(0.0)).otherwise(p))


def random_intercept(rows: DataFrame, ids: Sequence[str], group: str, y: str, x: Sequence[str]) -> DataFrame:
    """(ids, n, n_groups, ratio, estimate, p_value) of y ~ 1 + x + (1 | group): the last of ``x`` and its test.

    The ratio with the least criterion is taken, the smallest of equals. p is from Student's t with
    n - groups - len(x) degrees of freedom. Rows without a finite ``y`` do not count. Where the columns are not
    independent, or no degree of freedom is left, ratio, estimate and p are null.
    """
    k = len(x) + 1
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in x], F.col(y).cast("double")]
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    ok = rows.where(is_finite(F.col(y)))
    g = ok.groupBy(*ids, group).agg(*[F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)], *[F.sum(cols[i] * cols[j]).alias(f"p{i}{j}") for i, j in pairs])
    r = F.col("ratio")
    e = g.withColumn("ratio", F.explode(F.array(*[F.lit(v) for v in RATIOS])))
    left = lambda i, j: F.col(f"p{i}{j}") - r / (1 + r * F.col("s0")) * F.col(f"s{i}") * F.col(f"s{j}")
    e = e.groupBy(*ids, "ratio").agg(*[F.sum(left(i, j)).alias(f"m{i}{j}") for i, j in pairs], F.sum(F.log1p(r * F.col("s0"))).alias("spread"), F.sum("s0").cast("long").alias("n"), F.count(F.lit(1)).alias("n_groups"))
    e = e.withColumn("logdet", F.lit(0.0))
    for p in range(k):
        pivot = F.when(F.col(f"m{p}{p}") > 1e-10, F.col(f"m{p}{p}"))
        if p == k - 1:
            e = e.withColumns({"slope": F.col(f"m{p}{k}") / pivot, "pivot": pivot})
        swept = {f"m{i}{j}": F.col(f"m{i}{j}") - F.col(f"m{p}{i}") * F.col(f"m{p}{j}") / pivot for i, j in pairs if i > p}
        e = e.withColumns({**swept, "logdet": F.col("logdet") + F.ln(pivot)})
    df = F.col("n") - k
    e = e.withColumn("s2", F.when(df > 0, F.greatest(F.col(f"m{k}{k}"), F.lit(0.0)) / df))
    crit = F.round(df * F.ln(F.greatest("s2", F.lit(1e-300))) + F.col("spread") + F.col("logdet"), 8)
    best = e.groupBy(*ids).agg(F.first("n").alias("n"), F.first("n_groups").alias("n_groups"), F.min(F.when(crit.isNotNull(), F.struct(crit.alias("crit"), "ratio", "slope", "pivot", "s2"))).alias("b"))
    free = F.col("n") - F.col("n_groups") - (k - 1)
    se = F.sqrt(F.col("b.s2") / F.col("b.pivot"))
    t = F.when(se > 0, F.col("b.slope") / F.when(se > 0, se)).otherwise(F.lit(float("inf")))
    fit = lambda c: F.when(free >= 1, c)
    return best.select(*ids, "n", "n_groups", fit(F.col("b.ratio")).alias("ratio"), fit(F.col("b.slope")).alias("estimate"), fit(F.when(F.col("b").isNotNull(), t_two_sided(t, free))).alias("p_value"))


def mixed_effect(rows: DataFrame, ids: Sequence[str], donor: str = "donor", treated: str = "treated", value: str = "value") -> DataFrame:
    """(ids, estimate, p_value, n, engine) of value ~ treated + (1 | donor): treated rows less the others.

    Fewer than four rows, one method or fewer than three donors give no estimate (engine none). An id whose rows
    have no finite value has n 0.
    """
    r = rows.withColumn("__x", F.col(treated).cast("double"))
    f = random_intercept(r, ids, donor, value, ["__x"])
    enough = (F.col("n") >= 4) & (F.col("n_groups") >= 3) & F.col("estimate").isNotNull()
    every = rows.select(*ids).distinct().join(f, list(ids), "left")
    return every.select(*ids, F.when(enough, F.col("estimate")).alias("estimate"), F.when(enough, F.col("p_value")).alias("p_value"), F.coalesce("n", F.lit(0)).alias("n"), F.when(enough, F.lit("reml")).otherwise(F.lit("none")).alias("engine"))


def interaction_effect(rows: DataFrame, ids: Sequence[str], fold: str = "fold", a: str = "a", b: str = "b", value: str = "value") -> DataFrame:
    """(ids, estimate, p_value, n, engine) of value ~ a * b + (1 | fold): the interaction, as in ``mixed_effect``.

    Without all four cells, with one fold or too few rows for the residual there is no estimate.
    """
    x = rows.withColumns({"__a": F.col(a).cast("double"), "__b": F.col(b).cast("double")}).withColumn("__ab", F.col("__a") * F.col("__b"))
    f = random_intercept(x, ids, fold, value, ["__a", "__b", "__ab"])
    enough = (F.col("n_groups") >= 2) & F.col("estimate").isNotNull()
    every = rows.select(*ids).distinct().join(f, list(ids), "left")
    return every.select(*ids, F.when(enough, F.col("estimate")).alias("estimate"), F.when(enough, F.col("p_value")).alias("p_value"), F.coalesce("n", F.lit(0)).alias("n"), F.when(enough, F.lit("reml")).otherwise(F.lit("none")).alias("engine"))
