"""Queries on region masks, evenness of vectors, levels, provenance and the cell ablation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..ml.samples import sample_taxon_ablation
from ..operators import cutoffs, profiles
from ..session import table
from .bridge import LEVELS
from .evaluation import METRICS, cell_coverage, cells, rounded
from .reads import COVS, IDS, ORACLES as _READS, _EV, _errors, confident


def region_mask(spark, d):
    e = _errors(spark, d).withColumnRenamed("user_id", "tname")
    return profiles.region_mask([e.where("event_type = 'error'"), e.where("event_type = 'purchase'")], {1: 300})


def vector_evenness(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.collect_list("l_quantity").alias("q"))
    return g.select("l_suppkey", F.round(profiles.vector_evenness(F.col("q")), 6).alias("coverage_evenness"))


def level_numbers(spark, d):
    level = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[F.col("o_orderpriority")]
    o = table(spark, d, "orders").select(profiles.level_number(level).alias("level"))
    return o.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def profile_provenance(spark, d):
    """Cut-offs of both profiles as a run records them."""
    best = cutoffs.recommend(cutoffs.sweep(confident(spark, d), IDS, COVS), 0.5)
    both = [profiles.provenance(spark, profiles.resolve_profile(n, best)) for n in ("fixed", "calculated")]
    return both[0].unionByName(both[1])


def cell_ablation(spark, d):
    """Held-out scores of cells with and without the coverage of their taxon, as rows of the study's metric table.

    Expected presence differs between the donors of this view, not within one, so donors are folded into three groups.
    """
    c = cells(spark, d, cell_coverage(spark, d)).where("arm = 'combined' and model = 'size'")
    group = F.substring("donor", 2, 1).cast("int") % 3
    c = c.withColumn("species", F.concat_ws("-", "species", "donor")).withColumn("fold", group + 1).withColumn("donor", F.concat(F.lit("G"), group.cast("string")))
    return rounded(sample_taxon_ablation(c), *METRICS)


QUERIES = {f.__name__: f for f in (region_mask, vector_evenness, level_numbers, profile_provenance, cell_ablation)}
ORACLES = {
    "region_mask": f"""WITH {_EV.split("isl AS")[0].rstrip().rstrip(",")},
src AS (SELECT user_id AS tname, start, "end" FROM ev WHERE event_type = 'error' AND "end" - start >= 1 UNION ALL SELECT user_id, start, "end" FROM ev WHERE event_type = 'purchase' AND "end" - start >= 300),
nw AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY tname ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS k FROM src),
il AS (SELECT *, sum(k) OVER (PARTITION BY tname ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM nw)
SELECT tname, min(start) AS start, max("end") AS "end" FROM il GROUP BY tname, g""",
    "vector_evenness": """SELECT l_suppkey, round(1 - (2 * sum(r * l_quantity) / (max(n) * sum(l_quantity)) - (max(n) + 1) / max(n)::DOUBLE), 6) AS coverage_evenness
FROM (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS r, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) GROUP BY 1""",
    "level_numbers": "SELECT o_orderpriority[1:1]::BIGINT AS level, count(*) AS n FROM orders GROUP BY 1",
    "profile_provenance": "SELECT 'fixed' AS name, '0.9' AS min_identity, '0.8' AS min_coverage UNION ALL SELECT 'calculated', gt_min_identity::VARCHAR, gt_min_coverage::VARCHAR FROM (" + _READS["cutoff_recommend"] + ")",
}
