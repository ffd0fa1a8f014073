"""Competitive scoring between references, three-class labels, detectability and leakage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def depleted(hosts: Sequence[DataFrame], target: DataFrame, key: str = "read_id", score: str = "score") -> DataFrame:
    """Keys whose best host score beats their best target score (none counts 0; ties survive)."""
    host = reduce(DataFrame.unionByName, [h.select(key, score) for h in hosts]).groupBy(key).agg(F.max(score).alias("host_score"))
    best = target.groupBy(key).agg(F.max(score).alias("target_score"))
    out = host.join(best, key, "left").withColumn("target_score", F.coalesce("target_score", F.lit(0.0)))
    return out.where(F.col("host_score") > F.col("target_score"))


def survivors(reads: DataFrame, removed: DataFrame, key: str = "read_id") -> DataFrame:
    return reads.join(removed.select(key), key, "left_anti")


def three_class(identity: Column, coverage: Column, target: Column, host: Column, ambiguous: Column, min_identity: float = 0.90, min_coverage: float = 0.80, margin: float = 0.0) -> Column:
    """ambiguous overrides positive, which overrides negative."""
    ok = F.coalesce((identity >= min_identity) & (coverage >= min_coverage) & (F.coalesce(target, F.lit(0.0)) > F.coalesce(host, F.lit(0.0)) + margin), F.lit(False))
    return F.when(F.coalesce(ambiguous, F.lit(False)), "ambiguous").when(ok, "positive").otherwise("negative")


def expected_genomes(cells: Column, abundance: Column, efficiency: float = 1.0, loaded: float = 1.0) -> Column:
    return cells * abundance * F.lit(efficiency) * F.lit(loaded)


def detection_probability(expected: Column) -> Column:
    return -F.expm1(-expected)


def apply_poisson_floor(labels: DataFrame, abundance: DataFrame | None, species: str = "species", cells: str = "concentration", level: str = "titration_level", cells_per_level: Mapping[str, float] | None = None, p_min: float = 0.95, efficiency: float = 1.0, loaded: float = 1.0) -> DataFrame:
    """Positives of taxa that are not reliably detectable become indeterminate; keeps label_prefloor.

    ``abundance`` (species, rel_abundance) is a reference table of some tens of rows. Without it the
    new columns are null and no row is indeterminate. ``cells_per_level`` is used where no row has a
    concentration (the caller passes it then).
    """
    if abundance is None:
        none = F.lit(None).cast("double")
        return labels.withColumns({"expected_cells": none, "p_detect": none, "indeterminate": F.lit(False), "label_prefloor": F.col("label")})
    if cells_per_level is not None:
        pairs = [x for k, v in cells_per_level.items() for x in (F.lit(k), F.lit(float(v)))]
        labels = labels.withColumn(cells, F.create_map(*pairs)[F.col(level)])
    d = labels.join(abundance.select(F.col(species), "rel_abundance"), species, "left")
    d = d.withColumn("expected_cells", expected_genomes(F.col(cells), F.col("rel_abundance"), efficiency, loaded))
    d = d.withColumn("p_detect", detection_probability(F.col("expected_cells")))
    d = d.withColumn("indeterminate", F.coalesce(F.col("p_detect") < p_min, F.lit(False))).withColumn("label_prefloor", F.col("label"))
    return d.withColumn("label", F.when((F.col("label") == "positive") & F.col("indeterminate"), "indeterminate").otherwise(F.col("label"))).drop("rel_abundance")


def expected_grid(samples: DataFrame, abundance: DataFrame, p_min: float = 0.95, efficiency: float = 1.0, loaded: float = 1.0) -> DataFrame:
    """Every sample with every taxon, its expected cells, and whether it should be present.

    Both sides are design tables; the cross product is the result asked for.
    """
    g = samples.crossJoin(abundance)
    g = g.withColumn("expected_cells", expected_genomes(F.col("concentration"), F.col("rel_abundance"), efficiency, loaded))
    g = g.withColumn("p_detect", detection_probability(F.col("expected_cells")))
    return g.withColumn("expected_present", F.coalesce(F.col("p_detect") >= p_min, F.lit(False)))


def floor_grid(levels: DataFrame, abundance: DataFrame, p_min: float = 0.95, efficiency: float = 1.0, loaded: float = 1.0) -> DataFrame:
    """Level by taxon detectability; what cannot be computed is indeterminate here."""
    g = levels.crossJoin(abundance)
    g = g.withColumn("expected_genomes", expected_genomes(F.col("total_cells"), F.col("rel_abundance"), efficiency, loaded))
    g = g.withColumn("p_detect", detection_probability(F.col("expected_genomes")))
    return g.withColumn("indeterminate", F.coalesce(F.col("p_detect") < p_min, F.lit(True)))


def leakage(labels: DataFrame, run: str = "run_id", level: str = "titration_level", control: str = "negative", label: str = "label_prefloor") -> DataFrame:
    """Positives in a run's control as an upper bound of leakage, in one pass of conditional counts."""
    neg, pos = F.col(level) == control, F.col(label) == "positive"
    g = labels.groupBy(run).agg(
        F.count_if(neg).alias("negative_reads"),
        F.count_if(neg & (F.col(label) == "negative")).alias("negative_background"),
        F.count_if(neg & pos).alias("negative_positive"),
        F.count_if(pos).alias("__pool"),
    )
    share = lambda d: F.try_divide(F.col("negative_positive").cast("double"), F.nullif(d.cast("double"), F.lit(0.0)))
    return g.select(run, "negative_reads", "negative_background", "negative_positive", share(F.col("negative_reads")).alias("leakage_upper_bound"), share(F.col("__pool")).alias("leakage_vs_positive_pool"))
