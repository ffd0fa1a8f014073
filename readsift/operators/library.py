"""Labels and features of whole libraries, composed from the operators on reads.

Alignments of many libraries can be labelled together: with ``keys=("library_id", "read_id")``, and
library_id on every input, there is one plan for all of them, in place of a loop over libraries.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import contig_species, read_id
from .features import feature_table
from .intervals import overlap_sweep
from .labels import three_class
from .topk import best_per_key


def label_library(target: DataFrame, hosts: Sequence[DataFrame], reads: DataFrame | None = None, regions: DataFrame | None = None, contigs: DataFrame | None = None, min_identity: float = 0.90, min_coverage: float = 0.80, margin: float = 0.0, keys: Sequence[str] = ("read_id",)) -> DataFrame:
    """Three-class label of every read, with its best target hit and best host score.

    ``target`` and ``hosts`` are alignments (``text.read_paf``; ``qname`` is the read). The labelled
    reads are those of ``reads``; without it, those with an alignment to the target or the first
    host. ``regions`` (tname, start, end) are ambiguous, ends included. ``contigs`` (contig,
    species) is a lookup of some tens of rows; without it the contig's name gives the species.
    A read without a hit scores 0 and has no species.
    """
    extra = [k for k in keys if k != "read_id"]
    named = lambda d: d.withColumn("read_id", read_id(F.col("qname")))
    hits = named(target)
    best = best_per_key(hits, keys, "score", ["_ord"]).select(
        *keys, F.col("score").alias("zymo_score"), F.col("identity").alias("zymo_ident"), F.col("coverage").alias("zymo_cov"),
        F.col("tname").alias("zymo_tname"), F.col("tstart").alias("zymo_tstart"), F.col("tend").alias("zymo_tend"),
    )
    # One aggregation serves all hosts, as only the highest score counts.
    host = reduce(DataFrame.unionByName, [named(h).select(*keys, "score") for h in hosts]).groupBy(*keys).agg(F.max("score").alias("human_score"))
    if reads is None:
        universe = hits.select(*keys).unionByName(named(hosts[0]).select(*keys)).distinct()
    else:
        universe = reads.select(*extra, read_id(F.col("read_id")).alias("read_id")).distinct()
    d = universe.join(best, list(keys), "left").join(host, list(keys), "left")
    d = d.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("zymo_score", "human_score")})
    if contigs is None:
        d = d.withColumn("species", contig_species(F.col("zymo_tname")))
    else:
        d = d.join(contigs.select(F.col("contig").alias("zymo_tname"), "species"), "zymo_tname", "left")
    ambiguous = F.lit(False)
    if regions is not None:
        at = d.withColumns({"start": F.col("zymo_tstart"), "end": F.col("zymo_tend")})
        d = overlap_sweep(at, regions.withColumnRenamed("tname", "zymo_tname"), "zymo_tname", "__in_region").drop("start", "end")
        ambiguous = F.col("__in_region")
    label = three_class(F.col("zymo_ident"), F.col("zymo_cov"), F.col("zymo_score"), F.col("human_score"), ambiguous, min_identity, min_coverage, margin)
    return d.withColumn("label", label).drop("__in_region").select(
        *keys, "zymo_score", "zymo_ident", "zymo_cov", "zymo_tname", "zymo_tstart", "zymo_tend", "human_score", "species", "label"
    )


def library_features(labels: DataFrame, sources: Sequence[DataFrame | None], keys: Sequence[str] = ("read_id",)) -> DataFrame:
    """``labels`` with the features of each read; sources that are None are left out.

    ``keys`` are unique in each source: with several libraries, (library_id, read_id).
    """
    return feature_table(labels, [s for s in sources if s is not None], keys)
