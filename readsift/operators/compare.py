"""Comparison of two labelling profiles, operating points and metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import quantiles


def crosstab(df: DataFrame, a: str = "label_a", b: str = "label_b") -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")).withColumn("changed", ~F.col(a).eqNullSafe(F.col(b)))


def flip_profile(df: DataFrame, values: Sequence[str], a: str = "label_a", b: str = "label_b") -> DataFrame:
    """Minimum, median and maximum of ``values`` among the rows whose label changed."""
    d = df.where(F.col(a) != F.col(b))
    ends = d.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"), *[x for v in values for x in (F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max"))])
    out = ends.join(quantiles(d, (a, b), {f"{v}_med": (v, 0.5) for v in values}), [a, b])
    return out.select(a, b, "n", *[f"{v}_{s}" for v in values for s in ("min", "med", "max")])


def read_calls(df: DataFrame, y: str = "y", score: str = "score", recall: float = 0.95) -> DataFrame:
    """ground_truth, model_call and correct at the score that keeps ``recall`` of the positives."""
    thr = quantiles(df.where(F.col(y) == 1), (), {"__thr": (score, round(1 - recall, 12))})
    d = df.crossJoin(F.broadcast(thr))  # one row
    d = d.withColumn("ground_truth", F.when(F.col(y) == 1, "positive").otherwise("negative"))
    d = d.withColumn("model_call", F.when(F.col(score) >= F.col("__thr"), "positive").otherwise("negative"))
    return d.withColumn("correct", F.col("ground_truth") == F.col("model_call")).drop("__thr")


def confusion(calls: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    truth, call = F.col("ground_truth") == "positive", F.col("model_call") == "positive"
    g = calls.groupBy(*groups).agg(F.count_if(truth & call).alias("tp"), F.count_if(~truth & call).alias("fp"), F.count_if(truth & ~call).alias("fn"), F.count_if(~truth & ~call).alias("tn"))
    div = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    return g.select(*groups, "tp", "fp", "fn", "tn", n.alias("n"), div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(tp + tn, n).alias("accuracy"))


def confusion_margins(calls: DataFrame) -> DataFrame:
    """Counts by truth and call with both margins ('all')."""
    g = calls.cube("ground_truth", "model_call").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.coalesce("ground_truth", F.lit("all")).alias("ground_truth"), F.coalesce("model_call", F.lit("all")).alias("model_call"), "n")


def fold_change(df: DataFrame, value: str, reference: Column, groups: Sequence[str]) -> DataFrame:
    """``value`` over the value of the group's reference row."""
    ref = df.groupBy(*groups).agg(F.max(F.when(reference, F.col(value))).alias("__ref"))
    return df.join(ref, list(groups)).withColumn("fold_change", F.round(F.try_divide(F.col(value), F.col("__ref")), 3)).drop("__ref")


def concordance(a: DataFrame, b: DataFrame, order: DataFrame) -> DataFrame:
    """Effects of two profiles side by side, in the order of the table (id, ord)."""
    x = a.select("id", F.col("effect").alias("effect_a"), F.col("significant").alias("sig_a"))
    y = b.select("id", F.col("effect").alias("effect_b"), F.col("significant").alias("sig_b"))
    d = x.join(y, "id", "full_outer").join(F.broadcast(order), "id")
    ea, eb = F.col("effect_a"), F.col("effect_b")
    return d.select(
        "ord", "id", "effect_a", "effect_b", "sig_a", "sig_b", (eb - ea).alias("delta"),
        F.when(ea != 0, eb / ea).alias("ratio"), (F.signum(ea) == F.signum(eb)).alias("sign_agree"),
        F.when(ea.isNotNull() | eb.isNotNull(), F.col("sig_a") == F.col("sig_b")).alias("verdict_agree"),
    )


def composition(df: DataFrame, level: str, labels: dict[str, str]) -> DataFrame:
    """Rows by profile, level and label; ``labels`` maps a profile to its label column."""
    each = F.array(*[F.struct(F.lit(p).alias("profile"), F.col(c).alias("label")) for p, c in labels.items()])
    return df.select(level, F.explode(each).alias("x")).groupBy(F.col("x.profile").alias("profile"), level, F.col("x.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def format_effect(x: Column) -> Column:
    small = F.format_string("%.2e", x)
    return F.when(x.isNull(), "-").when(F.abs(x) >= 0.01, F.format_string("%.3f", x)).otherwise(small)


def format_p(p: Column) -> Column:
    return F.when(p.isNull(), "-").when(p == 0, "<1e-16").when(p < 1e-4, F.format_string("%.1e", p)).otherwise(F.format_string("%.4f", p))


def hypothesis_table(results: DataFrame, order: DataFrame) -> DataFrame:
    """The report's rows: formatted effect, interval (only if it holds the effect), p values and verdict."""
    d = F.broadcast(order).join(results, "id", "left")
    md, lo, hi = F.col("median_diff"), F.col("ci_lo"), F.col("ci_hi")
    ci = F.when((lo <= md) & (md <= hi), F.concat(F.lit("["), format_effect(lo), F.lit(", "), format_effect(hi), F.lit("]"))).otherwise("-")
    verdict = F.when(md.isNull(), "not run").when(F.coalesce("significant", F.lit(False)), "yes").otherwise("no")
    return d.select("ord", F.col("id").alias("hypothesis"), "family", format_effect(md).alias("effect"), ci.alias("ci_95"), format_p(F.col("wilcox_p")).alias("p_raw"), format_p(F.col("holm_sidak_p")).alias("p_holm_sidak"), verdict.alias("significant"), F.coalesce("note", F.lit("")).alias("note"))
