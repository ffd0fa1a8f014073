"""Small-sample tests on per-fold metric tables.

Folds are few (8 in the study design), so exact enumeration is a table of 2^n sign vectors made by
Spark itself. Bootstrap intervals are in ``resample``, mixed models in ``mixed``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ranks import quantiles, running


def paired(a: DataFrame, b: DataFrame, fold: str = "fold", value: str = "value") -> DataFrame:
    """(fold, a, b, d) for the folds both have."""
    x = a.select(fold, F.col(value).alias("a"))
    return x.join(b.select(fold, F.col(value).alias("b")), fold).withColumn("d", F.col("a") - F.col("b"))


def wilcoxon_exact(diffs: DataFrame, groups: Sequence[str], d: str = "d", max_n: int = 16) -> DataFrame:
    """Two-sided exact signed-rank test of each group: n, statistic (W+) and p.

    Zero differences are left out and ties get mid-ranks. The null distribution is enumerated over
    all 2^n sign vectors; groups above ``max_n`` differences get the normal approximation with
    continuity and tie correction. A group of zeros has a null p.
    """
    every = diffs.select(*groups).distinct()
    x = diffs.where(F.col(d).isNotNull() & (F.col(d) != 0)).withColumn("__a", F.round(F.abs(F.col(d)), 12))
    part = Window.partitionBy(*groups)
    low = F.rank().over(part.orderBy("__a"))
    same = F.count(F.lit(1)).over(Window.partitionBy(*groups, "__a"))
    x = x.withColumn("__r", low + (same - 1) / 2.0).withColumn("__t", same)
    g = x.groupBy(*groups).agg(
        F.array_sort(F.collect_list("__r")).alias("ranks"),
        F.sum(F.when(F.col(d) > 0, F.col("__r")).otherwise(0.0)).alias("statistic"),
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("__t") * F.col("__t") - 1) / 48.0).alias("__tie"),
    )
    n = F.col("n")
    exact = F.when(n <= max_n, F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.least(n, F.lit(max_n)).cast("int")) - 1)).otherwise(F.array(F.lit(0)))
    mean = F.aggregate("ranks", F.lit(0.0), lambda s, r: s + r) / 2
    far = F.abs(F.col("statistic") - mean)
    signs = g.select(*groups, "n", "statistic", "ranks", "__tie", mean.alias("mean"), far.alias("far"), F.explode(exact).alias("m"))
    w = F.aggregate(
        F.transform("ranks", lambda r, i: F.when(F.call_function("getbit", F.col("m").cast("long"), i) == 1, r).otherwise(0.0)), F.lit(0.0), lambda s, r: s + r
    )
    hit = (F.abs(w - F.col("mean")) >= F.col("far") - 1e-9).cast("double")
    p = signs.groupBy(*groups, "n", "statistic", "mean", "__tie").agg(F.avg(hit).alias("__p"))
    var = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("__tie")
    z = F.greatest(F.abs(F.col("statistic") - F.col("mean")) - 0.5, F.lit(0.0)) / F.sqrt(var)
    out = p.select(*groups, "n", "statistic", F.when(n <= max_n, F.col("__p")).otherwise(2 * (1 - normal_cdf(z))).alias("p_value"))
    return every.join(out, list(groups), "left").withColumn("n", F.coalesce("n", F.lit(0)))


def normal_cdf(z):
    """Standard normal distribution function of a non-negative argument (Abramowitz-Stegun 26.2.17, error below 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return 1 - F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


def holm_sidak(p: DataFrame, id: str = "id", value: str = "p") -> DataFrame:
    """Step-down adjusted p values over the rows of one family.

    Nulls sort last but count in the number of tests; equal p values are ordered by ``id``.
    """
    one = Window.partitionBy(F.lit(0))
    order = one.orderBy(F.asc_nulls_last(value), id)
    m, i = F.count(F.lit(1)).over(one), F.row_number().over(order)
    d = p.withColumn("__adj", 1 - F.pow(1 - F.col(value), m - i + 1))
    top = F.max("__adj").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("p_adjusted", F.when(F.col(value).isNotNull(), F.least(top, F.lit(1.0)))).drop("__adj")


def interaction(df: DataFrame, method: str = "method", group: str = "level_group", value: str = "auprc") -> DataFrame:
    """(low_a - low_b) - (high_a - high_b) of cell means, with the t of its pooled variance.

    ``method`` has values a and b, ``group`` low and high: the interaction of the 2x2 linear model.
    """
    cell = df.where(F.col(value).isNotNull()).groupBy(method, group).agg(F.avg(value).alias("m"), F.count(F.lit(1)).alias("n"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))
    sign = F.when((F.col(method) == "a") == (F.col(group) == "low"), 1.0).otherwise(-1.0)
    g = cell.agg(F.sum(sign * F.col("m")).alias("estimate"), F.sum((F.col("n") - 1) * F.col("v")).alias("__ss"), F.sum("n").alias("n"), F.sum(1 / F.col("n")).alias("__inv"))
    se = F.sqrt(F.col("__ss") / (F.col("n") - 4) * F.col("__inv"))
    return g.select("estimate", F.col("n"), F.try_divide(F.col("estimate"), se).alias("t"))


def rank_sum(df: DataFrame, group: str, score: str) -> DataFrame:
    """Two-sample rank-sum test of ``score`` between rows with ``group`` 1 and 0: medians, W and p.

    Mid-ranks come from running counts over distinct scores, which are spread over many tasks; normal
    approximation with tie and continuity correction.
    """
    ties = df.where(F.col(group).isin(0, 1) & F.col(score).isNotNull()).groupBy(score).agg(F.count(F.lit(1)).alias("t"), F.sum((F.col(group) == 1).cast("long")).alias("n1"))
    r = running(ties, (), [F.col(score)], {"upto": F.col("t")}).withColumn("rank", F.col("upto") - F.col("t") + (F.col("t") + 1) / 2.0)
    t = F.col("t").cast("double")
    g = r.agg(F.sum(F.col("rank") * F.col("n1")).alias("r1"), F.sum("n1").cast("double").alias("a"), F.sum(F.col("t") - F.col("n1")).cast("double").alias("b"), F.sum(t * t * t - t).alias("tie"))
    a, b = F.col("a"), F.col("b")
    n = a + b
    w = F.col("r1") - a * (a + 1) / 2
    sd = F.sqrt(a * b / 12 * (n + 1 - F.col("tie") / (n * (n - 1))))
    z = F.greatest(F.abs(w - a * b / 2) - 0.5, F.lit(0.0)) / sd
    two = df.select(F.when(F.col(group) == 1, F.col(score)).alias("one"), F.when(F.col(group) == 0, F.col(score)).alias("zero"))
    med = quantiles(two, (), {"median_1": ("one", 0.5), "median_0": ("zero", 0.5)})
    out = g.select(a.cast("long").alias("n_1"), b.cast("long").alias("n_0"), w.alias("w"), (2 * (1 - normal_cdf(z))).alias("p_value"))
    return out.crossJoin(med).withColumn("median_shift", F.col("median_1") - F.col("median_0"))  # one row each
