"""Sample-by-taxon aggregation with an expected-presence truth and explicit missed detections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import is_finite
from .ranks import quantiles

SLICE = ("arm", "model", "scheme", "fold", "donor", "titration_level")


def thresholds(preds: DataFrame, by: Sequence[str] = ("arm", "model"), score: str = "score", q: float = 0.75) -> DataFrame:
    """The exact type-7 quantile of all scores of each ``by``, pooled over schemes, folds and donors."""
    return quantiles(preds, by, {"thr_am": (score, q)})


def aggregate_sample_taxon(preds: DataFrame, expected: DataFrame | None, coverage: DataFrame | None = None, p_min: float = 0.95, quantile: float = 0.75) -> DataFrame:
    """One row a (arm, model, scheme, fold, donor, titration_level, species).

    With ``expected`` (donor, titration_level, species, expected_cells, p_detect, expected_present)
    y is expected presence, cells with 0 < p_detect < ``p_min`` are dropped, and expected taxa
    without a read are added as missed, scored one below the smallest finite max_score.
    """
    d = preds.join(F.broadcast(thresholds(preds, q=quantile)), ["arm", "model"])  # one row a model
    depth = preds.groupBy(*SLICE).agg(F.count(F.lit(1)).alias("library_total"))
    cell = d.where("species is not null").groupBy(*SLICE, "species").agg(
        F.count_if(F.col("score") > F.col("thr_am")).alias("n_reads_above_thr"),
        F.avg("score").alias("mean_score"),
        F.max("score").alias("max_score"),
        F.max((F.col("y") == 1).cast("int")).alias("y_obs"),
    )
    out = cell.join(depth, list(SLICE), "left")
    out = out.withColumn("reads_above_thr_per_million", F.col("n_reads_above_thr") / F.greatest("library_total", F.lit(1)) * 1e6)
    at = ["donor", "titration_level", "species"]
    if expected is None:
        out = out.withColumn("y", F.col("y_obs"))
    else:
        out = out.join(expected.select(*at, "expected_cells", "p_detect", "expected_present"), at, "left")
        out = out.where(F.coalesce(~((F.col("p_detect") > 0) & (F.col("p_detect") < p_min)), F.lit(True)))
        out = out.withColumn("y", F.coalesce(F.col("expected_present"), F.lit(False)).cast("int"))
    if coverage is not None:
        out = out.join(coverage.select(*at, "genome_breadth", "coverage_evenness"), at, "left")
    else:
        none = F.lit(None).cast("double")
        out = out.withColumns({"genome_breadth": none, "coverage_evenness": none})
    if expected is None:
        return out
    present = expected.where("expected_present").select(*at)
    universe = preds.select(*SLICE).distinct().join(present, ["donor", "titration_level"])
    missed = universe.join(out.select(*SLICE, "species"), [*SLICE, "species"], "left_anti").join(depth, list(SLICE), "left")
    low = out.where(is_finite(F.col("max_score"))).agg(F.coalesce(F.min("max_score") - 1, F.lit(-1.0)).alias("low"))
    missed = missed.crossJoin(F.broadcast(low)).select(  # one row
        *SLICE, "species", "library_total",
        F.lit(0).cast("long").alias("n_reads_above_thr"), F.col("low").alias("mean_score"), F.col("low").alias("max_score"),
        F.lit(0.0).alias("reads_above_thr_per_million"), F.lit(0).alias("y_obs"), F.lit(1).alias("y"),
        F.lit(0.0).alias("genome_breadth"), F.lit(0.0).alias("coverage_evenness"),
    )
    return out.unionByName(missed, allowMissingColumns=True)
