"""Cut-off sensitivity: distributions, the grid sweep and the recommended pair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import quantiles

PROBS = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)


def distribution(df: DataFrame, metrics: Sequence[str] = ("identity", "coverage"), probs: Sequence[float] = PROBS) -> DataFrame:
    """(metric, quantile, value, mean, n): exact type-7 quantiles of all metrics from one ordered table of counts."""
    agg = df.agg(*[x for m in metrics for x in (F.avg(m).alias(f"m_{m}"), F.count(m).alias(f"n_{m}"))])
    found = quantiles(df, (), {f"q_{m}_{i}": (m, p) for m in metrics for i, p in enumerate(probs)})
    agg = agg.crossJoin(F.broadcast(found))  # one row each
    names = F.array(*[F.lit(f"p{round(p * 100)}") for p in probs])
    rows = [F.struct(F.lit(m).alias("metric"), F.array(*[f"q_{m}_{i}" for i in range(len(probs))]).alias("q"), F.col(f"m_{m}").alias("mean"), F.col(f"n_{m}").alias("n")) for m in metrics]
    r = agg.select(F.explode(F.array(*rows)).alias("r"))
    r = r.select("r.*", F.posexplode("r.q").alias("i", "value"))
    return r.select("metric", names[F.col("i")].alias("quantile"), "value", "mean", "n")


def sweep(df: DataFrame, identities: Sequence[float], coverages: Sequence[float], current: tuple[float, float] = (0.90, 0.80)) -> DataFrame:
    """How many rows each pair of cut-offs retains.

    Rows fall into a bucket of the grid (the number of cut-offs they pass on each axis), so the rows
    are read and aggregated once, and the pairs are suffix sums over a table of the grid's size.
    """
    ids, covs = sorted(identities), sorted(coverages)
    passed = lambda c, cuts: sum((F.coalesce(F.col(c) >= x, F.lit(False)).cast("int") for x in cuts), F.lit(0))
    hist = df.groupBy(passed("identity", ids).alias("bi"), passed("coverage", covs).alias("bc")).agg(F.count(F.lit(1)).alias("c"))
    spark = df.sparkSession
    grid = spark.createDataFrame([(i + 1, j + 1, float(a), float(b)) for i, a in enumerate(ids) for j, b in enumerate(covs)], "i int, j int, gt_min_identity double, gt_min_coverage double")
    total = hist.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_confident"))
    kept = grid.join(F.broadcast(hist), (F.col("bi") >= F.col("i")) & (F.col("bc") >= F.col("j")), "left")
    kept = kept.groupBy("gt_min_identity", "gt_min_coverage").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_retained")).crossJoin(F.broadcast(total))
    near = (F.abs(F.col("gt_min_identity") - current[0]) < 1e-9) & (F.abs(F.col("gt_min_coverage") - current[1]) < 1e-9)
    return kept.select("gt_min_identity", "gt_min_coverage", "n_confident", "n_retained", (F.col("n_retained") / F.greatest("n_confident", F.lit(1))).alias("frac_retained"), near.alias("is_current"))


def recommend(grid: DataFrame, retain: float = 0.95) -> DataFrame:
    """The strictest pair that retains enough, else the one that retains most."""
    ok = F.col("frac_retained") >= retain
    order = [F.desc(ok), F.desc(F.when(ok, F.col("gt_min_identity"))), F.desc(F.when(ok, F.col("gt_min_coverage"))), F.desc("frac_retained"), "gt_min_identity", "gt_min_coverage"]
    return grid.orderBy(*order).limit(1)
