"""The study's table of hypotheses as DataFrames.

Metric tables hold a row for each arm, model, fold and stratum. A design table of contrasts is joined
with them, so that all contrasts are one plan; the driver sees the names of the chosen families only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import is_finite
from ..operators.ranks import quantiles
from . import mixed, tests
from .resample import median_intervals

FAMILIES = ("glm", "random_forest", "boosted_trees", "glmm")
TREES = ("random_forest", "boosted_trees")
SINGLE_ARMS = ("blast_only", "kraken2_only")
SOURCES = ("truth", "classifier")
LOW, HIGH = ("c4", "c5"), ("c1", "c2")
#: Hypotheses that are listed and not run.
NOT_RUN = {"H7": ("adapter enrichment in false against true positives", "deferred: no adapter content"), "H8": ("feed-forward network against boosted trees", "dropped: no network in the comparison")}
DESIGN = "id string, family string, metric string, arm_a string, model_a string, level_a string, arm_b string, model_b string, level_b string, comparison string, note string"
RESULT = ("id", "family", "comparison", "n_folds", "median_diff", "ci_lo", "ci_hi", "wilcox_p", "note")


def vectors(metrics: DataFrame, calibration: DataFrame | None = None, recall: float = 0.95) -> DataFrame:
    """(metric, arm, model, scheme, level, fold, value) over all strata, one value a fold.

    Of rows for several recall targets the primary one stays, of rows with and without truncated reads
    those with them. Brier scores come from ``calibration``.
    """
    m = metrics.where("stratum = 'all'")
    if "truncated_included" in m.columns:
        m = m.where("coalesce(truncated_included, true)")
    if "recall_target" in m.columns:
        m = m.where(F.col("recall_target") == recall)
    key = ("arm", "model", "scheme")
    v = m.select(F.lit("auprc").alias("metric"), *key, "level", "fold", F.col("auprc").alias("value"))
    if calibration is not None:
        v = v.unionByName(calibration.select(F.lit("brier").alias("metric"), *key, F.lit("read").alias("level"), "fold", F.col("brier").alias("value")))
    return v


def _best(df: DataFrame, name: str, value: str, among: Sequence[str]) -> str | None:
    place = F.array_position(F.array(*[F.lit(x) for x in among]), F.col(name))
    d = df.where(F.col(name).isin(*among) & is_finite(F.col(value)))
    row = d.groupBy(name).agg(F.avg(value).alias("m")).orderBy(F.desc("m"), place).first()
    return row[0] if row else None


def choose_family(inner: DataFrame | None, values: DataFrame, families: Sequence[str] = FAMILIES, arm: str = "combined") -> str:
    """The family with the best mean inner score; outer folds decide only where no inner score exists.

    The first of equals in the order of ``families`` wins; without any value it is boosted trees.
    """
    found = _best(inner.where(F.col("arm") == arm), "model", "inner_auprc", families) if inner is not None else None
    if found is None:
        outer = values.where((F.col("metric") == "auprc") & (F.col("arm") == arm) & (F.col("level") == "read") & (F.col("scheme") == "LOEO"))
        found = _best(outer, "model", "value", families)
    return found or ("boosted_trees" if "boosted_trees" in families else families[0])


def choose_arm(values: DataFrame, model: str, arms: Sequence[str] = SINGLE_ARMS) -> str:
    """The single arm with the best mean outer value of ``model``."""
    outer = values.where((F.col("metric") == "auprc") & (F.col("model") == model) & (F.col("level") == "read") & (F.col("scheme") == "LOEO"))
    return _best(outer, "arm", "value", arms) or arms[0]


def design(spark, family: str, tree: str, single: str, ablated: str = "combined_minus_H5_key", sources: Sequence[str] = SOURCES) -> DataFrame:
    """The paired contrasts of the study. Rows of family ``source`` serve the note of H9 only."""
    read, cell, c = "read", "sample_taxon", "combined"
    rows = [
        ("H1", "primary", "auprc", c, family, read, single, family, read, f"AUPRC combined({family}) - {single}({family})", ""),
        ("H2", "primary", "auprc", c, family, read, c, "fixed_threshold", read, f"AUPRC combined({family}) - combined(fixed_threshold)", ""),
        ("H4", "primary", "auprc", c, tree, read, c, "glm", read, f"AUPRC combined({tree}) - combined(glm)", "tree family by inner scores"),
        ("H5", "primary", "auprc", c, "boosted_trees", read, ablated, "boosted_trees", read, f"AUPRC combined - {ablated} (boosted_trees)", "margin and human blocks; breadth is H5b"),
        ("H6", "primary", "auprc", c, family, cell, c, "fixed_threshold", read, f"AUPRC sample_taxon({family}) - read(fixed_threshold)", ""),
        ("H9", "secondary", "auprc", c, "glmm_none", read, c, "glm", read, "AUPRC GLMM(1|donor) - GLM", "donor term alone"),
        ("H12", "secondary", "brier", c, "fixed_threshold", read, c, family, read, f"Brier fixed_threshold - {family}", "positive: the model is better calibrated"),
        ("H5b", "secondary", "auprc", c, "sxt_full", cell, c, "sxt_minus_breadth", cell, "AUPRC sample_taxon full - minus breadth", "needs coverage of cells"),
    ]
    rows += [(f"H9b_{s}", "secondary", "auprc", c, f"glmm_{s}", read, c, "glmm_none", read, f"AUPRC GLMM(1|donor+1|species[{s}]) - GLMM(1|donor)", f"species source = {s}") for s in sources]
    rows += [(s, "source", "auprc", c, f"glmm_{s}", read, c, "glm", read, f"AUPRC GLMM[{s}] - GLM", "") for s in ("none", *sources)]
    return spark.createDataFrame(rows, DESIGN)


def differences(values: DataFrame, pairs: DataFrame, scheme: str = "LOEO") -> DataFrame:
    """(id, fold, d) of every pair over the folds that both sides have."""
    v = values.where(F.col("scheme") == scheme).select("metric", "arm", "model", "level", "fold", "value")
    side = lambda s: v.select("metric", "fold", *[F.col(k).alias(f"{k}_{s}") for k in ("arm", "model", "level")], F.col("value").alias(s))
    p = F.broadcast(pairs)  # the design: some ten rows
    both = side("a").join(p, ["metric", "arm_a", "model_a", "level_a"]).join(side("b"), ["metric", "arm_b", "model_b", "level_b", "fold"])
    return both.select("id", "fold", (F.col("a") - F.col("b")).alias("d"))


def intervals(diffs: DataFrame, reps: int = 2000, seed: int = 1729) -> DataFrame:
    """(id, ci_lo, ci_hi): bootstrap of each contrast's median; a group is one value a fold."""
    return median_intervals(diffs, ["id"], "d", reps, seed=seed).select("id", "ci_lo", "ci_hi")


def contrasts(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, n_folds, median_diff, wilcox_p) of every pair; a pair without common folds has nulls and 0 folds."""
    d = differences(values, pairs)
    finite = F.when(is_finite(F.col("d")), F.col("d"))
    level = d.groupBy("id").agg(F.count(F.lit(1)).alias("n_folds"), F.median(finite).alias("median_diff"))
    p = tests.wilcoxon_exact(d.where(is_finite(F.col("d"))), ["id"]).select("id", F.col("p_value").alias("wilcox_p"))
    got = pairs.select("id").join(level, "id", "left").join(p, "id", "left")
    return got.select("id", F.coalesce("n_folds", F.lit(0)).alias("n_folds"), "median_diff", "wilcox_p")


def source_signs(effects: DataFrame) -> DataFrame:
    """One row: the sign of GLMM - GLM for each species source, and whether all non-zero signs agree."""
    s = effects.where("median_diff is not null").select("id", F.signum("median_diff").cast("int").alias("s"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "s"))), lambda x: F.format_string("%s:%+d", x["id"], x["s"])), ", ")
    robust = F.count_distinct(F.when(F.col("s") != 0, F.col("s"))) <= 1
    return s.agg(F.concat(F.lit("; sign of GLMM - GLM by source {"), text, F.when(robust, F.lit("} -> ROBUST")).otherwise(F.lit("} -> SOURCE-DEPENDENT"))).alias("signs"))


def interaction_row(metrics: DataFrame, family: str, recall: float = 0.95) -> DataFrame:
    """H3: how much larger the model's gain is at low than at high levels, with a random intercept a fold."""
    m = metrics.where((F.col("level") == "read") & (F.col("scheme") == "LOEO") & (F.col("arm") == "combined") & F.col("model").isin(family, "fixed_threshold") & F.col("stratum").isin(*LOW, *HIGH))
    if "truncated_included" in m.columns:
        m = m.where("truncated_included")
    if "recall_target" in m.columns:
        m = m.where(F.col("recall_target") == recall)
    rows = m.select(F.lit("H3").alias("id"), "fold", (F.col("model") == family).alias("ml"), F.col("stratum").isin(*LOW).alias("low"), "auprc").persist()  # folds x 4 levels x 2
    e = mixed.interaction_effect(rows, ["id"], "fold", "ml", "low", "auprc")
    n = rows.agg(F.count_distinct("fold").alias("n_folds")).withColumn("id", F.lit("H3"))
    none = F.lit(None).cast("double")
    return n.join(e, "id", "left").select(
        "id", F.lit("primary").alias("family"), F.lit("interaction method x level, random intercept by fold").alias("comparison"), "n_folds", F.col("estimate").alias("median_diff"),
        none.alias("ci_lo"), none.alias("ci_hi"), F.col("p_value").alias("wilcox_p"), F.concat(F.lit("fit="), F.coalesce("engine", F.lit("none"))).alias("note"),
    )


def degradation(values: DataFrame) -> DataFrame:
    """H10: median of donor-held-out less that of taxon-held-out folds, which are not paired.

    The interval is that of the taxon-held-out level, as the study reports it.
    """
    v = values.where("metric = 'auprc' and arm = 'combined' and model = 'boosted_trees' and level = 'read'")
    of = lambda s: F.when((F.col("scheme") == s) & is_finite(F.col("value")), F.col("value"))
    m = v.agg(F.median(of("LOEO")).alias("a"), F.median(of("LOTO")).alias("b"), F.count(F.when(F.col("scheme") == "LOTO", 1)).alias("n_folds")).withColumn("id", F.lit("H10"))
    ci = intervals(v.where("scheme = 'LOTO'").select(F.lit("H10").alias("id"), "fold", F.col("value").alias("d")))
    note = F.format_string("LOEO median %.3f, LOTO median %.3f", "a", "b")
    return m.join(ci, "id", "left").select("id", F.lit("secondary").alias("family"), F.lit("AUPRC LOEO - LOTO").alias("comparison"), "n_folds", (F.col("a") - F.col("b")).alias("median_diff"), "ci_lo", "ci_hi", F.lit(None).cast("double").alias("wilcox_p"), note.alias("note"))


def truncated_shift(preds: DataFrame) -> DataFrame:
    """H11: scores of negative reads that were truncated against the others, and their share of high false positives.

    High means above the type-7 upper quartile of all scores.
    """
    d = preds.where("arm = 'combined' and model = 'boosted_trees' and scheme = 'LOEO' and end_reason_unblock is not null").where(is_finite(F.col("score")))
    shift = tests.rank_sum(d.where("y = 0"), "end_reason_unblock", "score").select(F.col("median_shift").alias("median_diff"), F.col("p_value").alias("wilcox_p"))
    high = quantiles(d, (), {"q": ("score", 0.75)})
    share = d.join(F.broadcast(high), F.col("score") > F.col("q")).where("y = 0").agg(F.avg((F.col("end_reason_unblock") == 1).cast("double")).alias("fp_share"))
    none = F.lit(None).cast("double")
    note = F.coalesce(F.format_string("share of truncated reads among high false positives = %.3f", F.round("fp_share", 6)), F.lit("no truncated reads known"))
    return shift.crossJoin(share).select(F.lit("H11").alias("id"), F.lit("secondary").alias("family"), F.lit("scores of truncated and other negative reads").alias("comparison"), F.lit(None).cast("long").alias("n_folds"), "median_diff", none.alias("ci_lo"), none.alias("ci_hi"), "wilcox_p", note.alias("note"))  # one row each


def hypothesis_rows(metrics: DataFrame, preds: DataFrame, calibration: DataFrame | None = None, inner: DataFrame | None = None, alpha: float = 0.05) -> DataFrame:
    """A row for each hypothesis H1 to H12, with H5b and H9b: effect, interval, p, adjusted p, significance.

    Holm-Sidak spans H1 to H6 only, and decides there; of secondary rows an interval without zero does.
    """
    spark = metrics.sparkSession
    v = vectors(metrics, calibration)
    family, tree = choose_family(inner, v), choose_family(inner, v, TREES)
    arms = [r[0] for r in metrics.select("arm").distinct().collect()]  # a handful of arms
    ablated = "combined_minus_H5_key" if "combined_minus_H5_key" in arms else "combined_minus_blast_margin"
    pairs = design(spark, family, tree, choose_arm(v, family), ablated)
    e = contrasts(v, pairs)
    full = pairs.join(e, "id").join(intervals(differences(v, pairs)), "id", "left")
    signs = source_signs(e.where(F.col("id").isin("none", *SOURCES)))
    paired = full.where("family <> 'source'").crossJoin(F.broadcast(signs))  # one row
    paired = paired.withColumn("note", F.when(F.col("id") == "H9", F.concat("note", "signs")).otherwise(F.col("note"))).select(*RESULT)
    kinds = "id string, family string, comparison string, n_folds long, median_diff double, ci_lo double, ci_hi double, wilcox_p double, note string"
    listed = [(k, "secondary", c, None, None, None, None, None, n) for k, (c, n) in NOT_RUN.items()]
    every = paired.unionByName(interaction_row(metrics, family)).unionByName(spark.createDataFrame(listed, kinds)).unionByName(degradation(v)).unionByName(truncated_shift(preds))
    first = tests.holm_sidak(every.where("family = 'primary'"), "id", "wilcox_p").withColumnRenamed("p_adjusted", "holm_sidak_p")
    first = first.withColumn("significant", F.coalesce(F.col("holm_sidak_p") < alpha, F.lit(False)))
    rest = every.where("family = 'secondary'").withColumn("holm_sidak_p", F.lit(None).cast("double"))
    rest = rest.withColumn("significant", F.coalesce((F.col("ci_lo") > 0) | (F.col("ci_hi") < 0), F.lit(False)))
    return first.unionByName(rest)


def mixed_supplement(metrics: DataFrame, inner: DataFrame | None = None, recall: float = 0.95) -> DataFrame:
    """H1, H2 and H4 again on the rows of all folds and levels, with a random intercept a fold."""
    spark = metrics.sparkSession
    v = vectors(metrics)
    family, tree = choose_family(inner, v), choose_family(inner, v, TREES)
    p = design(spark, family, tree, choose_arm(v, family)).where("id in ('H1', 'H2', 'H4')")
    m = metrics.where("level = 'read' and scheme = 'LOEO' and stratum <> 'all'")
    if "recall_target" in m.columns:
        m = m.where(F.col("recall_target") == recall)
    m = m.select("arm", "model", "fold", "auprc")
    on = lambda s: (m.arm == p[f"arm_{s}"]) & (m.model == p[f"model_{s}"])
    d = m.join(F.broadcast(p), on("a") | on("b")).select("id", "comparison", on("a").alias("treated"), "fold", "auprc")
    e = mixed.mixed_effect(d, ["id", "comparison"], "fold", "treated", "auprc")
    return e.select("id", "comparison", F.col("estimate").alias("mixed_estimate"), F.col("p_value").alias("mixed_p"), F.col("n").alias("n_units"), "engine")
