"""Ranking metrics: average precision, precision and FDR at a recall, Brier score.

One score-descending pass of running counts serves all of them, spread over many tasks however large
a group is (``ranks.running``). Rows of a tie are ranked by ``ties``, as metrics that step row by row
depend on the order of equal scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from .ranks import running

TARGETS = (0.90, 0.95, 0.99)
#: Scores that both classes share, up to which they are sent to every task (some 100 bytes each).
BROADCAST = 300_000


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def metric_rows(df: DataFrame, groups: Sequence[str], y: str, score: str, ties: Sequence[str], targets: Sequence[float] = TARGETS) -> DataFrame:
    """auprc, prec_at_recall, fdr_at_recall, n_pos, n_neg: one row a group and target.

    Rows without a finite score or a label are left out. A group without both classes keeps its
    counts and has null metrics. Precision at a recall is the best over all ranks that reach it.
    """
    d = df.select(*groups, F.col(y).alias("__y"), F.col(score).cast("double").alias("__s"), *[F.col(c).alias(f"__t{i}") for i, c in enumerate(ties)])
    ok = is_finite(F.col("__s")) & F.col("__y").isNotNull()
    d = d.withColumn("__y", F.when(ok, F.col("__y"))).withColumn("__s", F.when(ok, F.col("__s")))
    d = running(d, groups, [F.desc("__s"), *[F.col(f"__t{i}") for i in range(len(ties))]], {"__tp": F.col("__y") == 1, "__n": F.col("__y").isNotNull()})
    precision, recall = F.col("__tp") / F.greatest(F.col("__n"), F.lit(1)), F.col("__tp") / F.nullif(F.col("__tp_all"), F.lit(0))
    d = d.withColumn("__prec", F.when(F.col("__y").isNotNull(), precision)).withColumn("__rec", recall)
    g = d.groupBy(*groups).agg(
        F.count_if(F.col("__y") == 1).alias("n_pos"),
        F.count_if(F.col("__y") == 0).alias("n_neg"),
        F.sum(F.when(F.col("__y") == 1, F.col("__prec"))).alias("__ap"),
        *[F.max(F.when(F.col("__rec") >= t, F.col("__prec"))).alias(f"__p{i}") for i, t in enumerate(targets)],
    )
    return _by_target(g, groups, targets)


def _by_target(g: DataFrame, groups: Sequence[str], targets: Sequence[float]) -> DataFrame:
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("recall_target"), F.col(f"__p{i}").alias("p")) for i, t in enumerate(targets)])
    g = g.withColumn("__m", F.explode(rows))
    return g.select(
        *groups,
        F.col("__m.recall_target").alias("recall_target"),
        F.when(both, F.col("__ap") / F.col("n_pos")).alias("auprc"),
        F.when(both, F.col("__m.p")).alias("prec_at_recall"),
        F.when(both, 1 - F.col("__m.p")).alias("fdr_at_recall"),
        "n_pos",
        "n_neg",
    )


def reciprocals(n: Column, p: Column) -> Column:
    """1 / (n + 1) + ... + 1 / (n + p): 32 terms one by one, the rest by Euler and Maclaurin to some 1e-15."""
    few = F.least(p, F.lit(32))
    first = F.aggregate(F.when(few > 0, F.sequence(F.lit(1).cast("long"), few)).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda s, i: s + 1 / (n + i))
    a, b = (n + few).cast("double"), (n + p).cast("double")
    tail = lambda x: 0.5 / x - 1 / (12 * x * x) + 1 / (120 * F.pow(x, 4)) - 1 / (252 * F.pow(x, 6))
    return first + F.when(p > few, F.log1p((b - a) / a) + tail(b) - tail(a)).otherwise(0.0)


def counted_metric_rows(df: DataFrame, groups: Sequence[str], y: str, score: str, ties: Sequence[str], targets: Sequence[float] = TARGETS, level: str | None = None) -> DataFrame:
    """The rows of ``metric_rows`` for scores that repeat: equal scores are counted before anything is ordered.

    Rows of one score and one class stand together whatever their ties, and their precisions have a closed sum. Only rows
    whose score both classes share within a group are ranked one by one, inside that score. With ``level`` groups have
    a ``stratum``, all and each level: rows are counted by level, and the counts copied. Where nearly every row has a score of its own
    ``metric_rows`` is cheaper.
    """
    spark, by = df.sparkSession, [*groups, *(["stratum"] if level else [])]
    d = df.select(*groups, *([F.col(level).cast("string").alias("stratum")] if level else []), F.col(y).alias("__y"), (F.col(score).cast("double") + 0.0).alias("__s"), *[F.col(c).alias(f"__t{i}") for i, c in enumerate(ties)])  # + 0.0: one zero
    ok = is_finite(F.col("__s")) & F.col("__y").isNotNull()
    d = d.withColumns({"__y": F.when(ok, F.col("__y")), "__s": F.when(ok, F.col("__s"))})
    copied = (lambda t: t.withColumn("stratum", F.explode(F.array(F.lit("all"), F.col("stratum"))))) if level else (lambda t: t)
    sums = {"__p": F.count_if(F.col("__y") == 1), "__q": F.count_if(F.col("__y") == 0), "__c": F.count("__y")}
    counts = d.groupBy(*by, "__s").agg(*[v.alias(k) for k, v in sums.items()])
    if level:
        counts = copied(counts).groupBy(*by, "__s").agg(*[F.sum(k).alias(k) for k in sums])
    r = running(counts, by, [F.desc("__s")], {"__tp": F.col("__p"), "__n": F.col("__c")})
    r = r.withColumns({"__tp0": F.col("__tp") - F.col("__p"), "__n0": F.col("__n") - F.col("__c"), "__whole": F.col("__tp_all"), "__shared": (F.col("__p") > 0) & (F.col("__p") < F.col("__c"))})
    path = scratch(spark)
    r.withColumn("__id", F.monotonically_increasing_id()).write.parquet(path)  # numbers that stay
    r = spark.read.parquet(path)

    p, c, tp0, n0, every = (F.col(x) for x in ("__p", "__c", "__tp0", "__n0", "__whole"))
    one = ~F.col("__shared") & (c > 0)
    ap = F.when(one & (p > 0), p - (n0 - tp0) * reciprocals(n0, p))
    # Precision rises along positives and falls along negatives: the last of those and the first of these are the best.
    best, reached = F.when(p > 0, F.col("__tp") / F.greatest(F.col("__n"), F.lit(1))).otherwise(tp0 / (n0 + 1)), F.col("__tp") / F.nullif(every, F.lit(0))
    parts = r.select(*by, "__p", "__q", ap.alias("__ap"), *[F.when(one & (reached >= t), best).alias(f"__p{i}") for i, t in enumerate(targets)])

    shared = r.where("__shared").select(*[F.col(b).alias(f"__b{i}") for i, b in enumerate(by)], F.col("__s").alias("__v"), "__id", "__tp0", "__n0", "__whole").withColumn("__h", F.xxhash64(*[f"__b{i}" for i in range(len(by))], "__v"))
    n_shared = r.where("__shared").count()
    if n_shared:
        rows = copied(d.where("__s is not null")).withColumn("__g", F.xxhash64(*by, "__s"))
        on = [F.col("__g") == F.col("__h"), F.col("__s") == F.col("__v"), *[F.col(b).eqNullSafe(F.col(f"__b{i}")) for i, b in enumerate(by)]]
        few = F.broadcast(shared) if n_shared <= BROADCAST else shared
        mixed, path = rows.join(few, on).select("__id", "__y", *[f"__t{i}" for i in range(len(ties))], "__tp0", "__n0", "__whole"), scratch(spark)
        mixed.write.parquet(path)
        m = running(spark.read.schema(mixed.schema).parquet(path), ["__id"], [F.col(f"__t{i}") for i in range(len(ties))], {"__tp": F.col("__y") == 1, "__n": F.lit(1)})
        prec, reached = (tp0 + F.col("__tp")) / (n0 + F.col("__n")), (tp0 + F.col("__tp")) / every
        got = m.groupBy("__id").agg(F.sum(F.when(F.col("__y") == 1, prec)).alias("__ap"), *[F.max(F.when(reached >= t, prec)).alias(f"__p{i}") for i, t in enumerate(targets)])
        none = F.lit(0).cast("long")
        parts = parts.unionByName(got.join(r.select("__id", *by), "__id").select(*by, none.alias("__p"), none.alias("__q"), "__ap", *[f"__p{i}" for i in range(len(targets))]))
    g = parts.groupBy(*by).agg(F.sum("__p").alias("n_pos"), F.sum("__q").alias("n_neg"), F.sum("__ap").alias("__ap"), *[F.max(f"__p{i}").alias(f"__p{i}") for i in range(len(targets))])
    return _by_target(g, by, targets)


def auprc(df: DataFrame, groups: Sequence[str], y: str, score: str, ties: Sequence[str]) -> DataFrame:
    return metric_rows(df, groups, y, score, ties, targets=(0.95,)).select(*groups, "auprc", "n_pos", "n_neg")


def stratified_metrics(df: DataFrame, groups: Sequence[str], y: str, score: str, ties: Sequence[str], truncated: str, level: str, targets: Sequence[float] = TARGETS) -> DataFrame:
    """Metrics with and without truncated rows, for all levels together and each by itself.

    Each row is copied to the reports it belongs to, so that one pass serves all four.
    """
    kept = F.when(F.coalesce(F.col(truncated) == 0, F.lit(True)), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    d = df.withColumn("truncated_included", F.explode(kept))
    d = d.withColumn("stratum", F.explode(F.array(F.lit("all"), F.col(level).cast("string"))))
    return metric_rows(d, [*groups, "truncated_included", "stratum"], y, score, ties, targets)


def leaderboard(df: DataFrame, groups: Sequence[str], facets: dict[str, str], y: str, score: str, ties: Sequence[str], targets: Sequence[float] = TARGETS) -> DataFrame:
    """Metrics pooled over folds: overall and by each facet, stacked as (facet, key)."""
    each = [F.struct(F.lit("overall").alias("facet"), F.lit("all").alias("key"))]
    each += [F.struct(F.lit(name).alias("facet"), F.col(c).cast("string").alias("key")) for name, c in facets.items()]
    d = df.withColumn("__f", F.explode(F.array(*each))).withColumn("facet", F.col("__f.facet")).withColumn("key", F.col("__f.key"))
    return metric_rows(d.drop("__f"), [*groups, "facet", "key"], y, score, ties, targets)


def brier(df: DataFrame, groups: Sequence[str], y: str, score: str) -> DataFrame:
    """Mean squared error of scores clipped to [0, 1], over finite scores."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score)))
    return df.where(is_finite(F.col(score))).groupBy(*groups).agg(F.avg(F.pow(p - F.col(y), 2)).alias("brier"), F.count(F.lit(1)).alias("n"))
