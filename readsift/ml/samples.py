"""Leave-one-donor-out scores of sample-by-taxon cells, with and without a feature block."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import TARGETS, is_finite, metric_rows
from ..session import scratch
from . import folded, models

SCORE_FEATURES = ("mean_score", "max_score", "reads_above_thr_per_million")
BREADTH = ("genome_breadth", "coverage_evenness")
PREFERENCE = ("boosted_trees", "random_forest", "glm", "glmm")


def preferred(cells: DataFrame, order: Sequence[str] = PREFERENCE) -> str | None:
    """The first model of ``order`` that the cells have."""
    have = {r[0] for r in cells.select("model").distinct().collect()}  # a handful of models
    return next((m for m in order if m in have), None)


def sample_taxon_ablation(cells: DataFrame, block: Sequence[str] = BREADTH, base: Sequence[str] = SCORE_FEATURES, name: str = "breadth", least: int = 5) -> DataFrame | None:
    """Metric rows of a logistic score on all features (model sxt_full) and on those less ``block`` (sxt_minus_<name>).

    ``cells`` are those of one arm and model. Each fold's score is trained on the cells of the other donors, without
    weights, missing values at their median; a fold whose training cells have one class has no row. The rows have the
    form of the study's metric tables (one a fold and recall target), so they can be joined to them. None where the
    block's columns have fewer than ``least`` finite non-zero values, as without a coverage table.
    """
    path = scratch(cells.sparkSession)  # cells, not reads; counted, and fitted twice
    cells.write.parquet(path)
    cells = cells.sparkSession.read.schema(cells.schema).parquet(path)
    known = [(is_finite(F.col(c)) & (F.col(c) != 0)).cast("long") for c in block]
    if (cells.agg(*[F.sum(k).alias(f"n{i}") for i, k in enumerate(known)]).select(sum((F.coalesce(f"n{i}", F.lit(0)) for i in range(len(block))), F.lit(0))).first()[0]) < least:
        return None
    c = cells.withColumn("read_id", F.concat_ws("|", "donor", "titration_level", "species")).withColumn("y", F.col("y").cast("double")).withColumnRenamed("fold", "cell_fold")
    c = c.withColumn("reads_above_thr_per_million", F.col("reads_above_thr_per_million") / 1e6)
    fit = models.Folds(lambda f, keep: folded.glm(f, keep, weighted=False))
    keep = ("read_id", "donor", "y", "arm", "scheme", "cell_fold")
    scores = None
    for model, names in (("sxt_full", [*base, *block]), (f"sxt_minus_{name}", list(base))):
        s = models.out_of_fold(c, names, fit, keep=keep).where("score is not null").select("read_id", "y", "arm", "scheme", F.col("cell_fold").alias("fold"), "score", F.lit(model).alias("model"))
        scores = s if scores is None else scores.unionByName(s)
    return cell_metrics(scores, "score", "read_id", levels=False)


def cell_metrics(cells: DataFrame, score: str = "max_score", cell: str | None = None, levels: bool = True, targets: Sequence[float] = TARGETS) -> DataFrame:
    """Metric rows of cells by arm, model, scheme and fold: stratum all and, with ``levels``, each level, in one pass."""
    if cell is None:
        cell, cells = "__cell", cells.withColumn("__cell", F.concat_ws("|", "donor", "titration_level", "species"))
    strata = F.array(F.lit("all"), *[F.col("titration_level")] * levels)
    d = cells.withColumn("stratum", F.explode(F.array_compact(strata)))
    m = metric_rows(d, ["arm", "model", "scheme", "fold", "stratum"], "y", score, [cell], targets)
    return m.withColumns({"level": F.lit("sample_taxon"), "truncated_included": F.lit(True)})
